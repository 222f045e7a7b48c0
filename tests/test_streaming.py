"""Streams against plain loops over the same rows, whatever order they arrive in."""

import datetime as dt
import random

from pyspark.sql import functions as F

from wayline.operators import simplify
from wayline.plans import registry
from wayline.plans import tables as t
from wayline.streaming import membership, online

EPOCH = dt.datetime(2024, 1, 1)
SCHEMA = "who long, cell string, time timestamp, question long"


def streamed(spark, tmp_path, batches, build):
    """What a stream over files, one a batch in order, has written when it has ended and a clock has struck."""
    source = tmp_path / "source"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(w, c, EPOCH + dt.timedelta(seconds=s), q) for w, c, s, q in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(str(source / f"part{i:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    stream, strike = online.closed(stream, "time", EPOCH + dt.timedelta(days=900), str(tmp_path / "clock"))
    return online.drained(build(stream), str(tmp_path / "out"), "append", strike).collect()


def test_membership_equals_a_plain_loop_with_late_and_repeated_rows(spark, tmp_path):
    rng, events = random.Random(2), []
    for i in range(400):
        who, cell = rng.randrange(4), rng.choice("ab")
        events.append((who, cell, rng.randrange(3000), None if rng.random() < 0.4 else i))
    events += rng.sample([e for e in events if e[3] is None], 20)  # added twice
    events.append((None, "a", 5, 1000))
    events.append((1, None, 5, None))
    # every row arrives within 500 seconds of its time
    arrival = sorted(events, key=lambda e: e[2] + rng.randrange(500))
    batches = [arrival[i : i + 110] for i in range(0, len(arrival), 110)]
    got = {r.question: r.member for r in streamed(spark, tmp_path, batches, lambda s: membership.members(s, "who", "cell", "time", F.col("question"), "5 minutes", "1 hour"))}
    want = {q: any(w == x and c == d and a <= at < a + 300 for x, d, a, add in events if add is None) for w, c, at, q in events if q is not None and w is not None}
    assert got == want and len(set(want.values())) == 2


def test_rows_later_than_allowed_are_dropped_and_state_goes(spark, tmp_path):
    batches = [[(1, "a", 0, None)], [(1, "a", 5000, None)], [(1, "a", 10, 7), (1, "a", 5001, 8)]]
    got = {r.question: r.member for r in streamed(spark, tmp_path, batches, lambda s: membership.members(s, "who", "cell", "time", F.col("question"), "10 minutes", "1 minute"))}
    assert got[8] is True and got.get(7, True) is True  # a row that late counts or is dropped


def test_last_seen_gives_one_span_for_each_while(spark, tmp_path):
    rng = random.Random(3)
    events = [(rng.randrange(3), rng.choice("ab"), rng.randrange(4000), None) for _ in range(150)]
    batches = [events[:70], events[70:]]
    rows = streamed(spark, tmp_path, batches, lambda s: online.last_seen(s, "who", "cell", "time", "100 seconds", "2 hours"))
    want = []
    for key in {e[:2] for e in events}:
        times = sorted(e[2] for e in events if e[:2] == key)
        spans = [[times[0], times[0], 1]]
        for x in times[1:]:
            if x < spans[-1][1] + 100:
                spans[-1][1:] = [x, spans[-1][2] + 1]
            else:
                spans.append([x, x, 1])
        want += [(*key, a, b + 100, n) for a, b, n in spans]
    seconds = lambda x: int((x - EPOCH).total_seconds())
    assert sorted((r.who, r.cell, seconds(r.begins), seconds(r.expires), r.n) for r in rows) == sorted(want)


def test_online_window_keeps_what_the_batch_operator_keeps(spark, sf_dir):
    found = registry.QUERIES["stream_opening_window"](spark, sf_dir).select("tid", "seq").collect()
    points = t.events(spark, sf_dir)
    batch = simplify.opening_window(points, 5.0)
    last = {(r.tid, r.seq) for r in points.groupBy("tid").agg(F.max("seq").alias("seq")).collect()}
    whole = {(r.tid, r.seq) for r in batch.select("tid", "seq").collect()}
    assert {(r.tid, r.seq) for r in found} | last == whole and len(found) < points.count()
