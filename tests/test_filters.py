"""Filter indexes and joins against loops over all filters."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline import storage
from wayline.operators import bloom, encodings, index, slices


def sets(spark, made):
    return spark.createDataFrame([(i, sorted(b)) for i, b in made.items()], "tid long, bits array<int>")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_slices_equal_a_subset_test_of_every_filter(spark):
    rng = random.Random(6)
    made = {i * 7: {rng.randrange(96) for _ in range(rng.randrange(60))} for i in range(300)}
    found = slices.build(sets(spark, made))
    asked = {k: set(rng.sample(range(96), n)) for k, n in enumerate((1, 1, 2, 3, 5, 96))} | {6: {200}, 7: {1, 200}}
    for bits in asked.values():
        assert sorted(r.tid for r in slices.holding(found, sorted(bits)).collect()) == sorted(t for t, own in made.items() if bits <= own)
    queries = spark.createDataFrame([(k, sorted(b) * 2) for k, b in asked.items()] + [(9, [])], "query long, bits array<int>")
    want = sorted((k, t) for k, bits in asked.items() for t, own in made.items() if bits <= own)
    assert sorted(map(tuple, slices.held(found, queries).collect())) == want


def test_slices_of_many_buckets(spark):
    made = spark.range(100_000).select(F.col("id").alias("tid"), F.array((F.col("id") % 7).cast("int"), (F.col("id") % 11 + 7).cast("int")).alias("bits"))
    found = slices.build(made)
    got = sorted(r.tid for r in slices.holding(found, [3, 12]).collect())
    assert got == [i for i in range(100_000) if i % 7 == 3 and i % 11 == 5]
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    assert "In(bit, [" in plan(slices.holding(found, [3, 12])) and slices.holding(found, [3, 50]).count() == 0


@pytest.mark.parametrize("m, limit, size", [(1024, 25, 40), (64, 14, 30), (100, 1, 20), (1024, 25, 3), (300, 2, 100)])
def test_close_pairs_equal_all_pairs(spark, m, limit, size):
    rng = random.Random(m + limit)
    made = {}
    for i in range(0, 160, 4):
        base = {rng.randrange(m) for _ in range(rng.randrange(size + 1))}
        for k, edits in enumerate((0, limit // 2, limit - 1, limit + 1)):
            made[i + k] = base ^ set(rng.sample(range(m), min(edits, m)))
    found = bloom.close_pairs(sets(spark, made), limit, m)
    want = sorted((a, b) for a in made for b in made if a < b and len(made[a] ^ made[b]) < limit)
    assert sorted(map(tuple, found.collect())) == want and want
    assert not any(word in plan(found) for word in ("NestedLoop", "Cartesian"))


def test_order_of_a_search(spark):
    cells = spark.createDataFrame([(1, "a"), (3, "b"), (3, "a"), (4, "c")], "tid long, cell string")
    asked = spark.createDataFrame([("a",), ("zz",)], "cell string")
    steps = lambda compat: [r.tid for r in index.search_order(cells, asked, 5, compat).orderBy("position").collect()]
    assert steps(True) == [1, 3, 0, 1, 2, 3, 4] and steps(False) == [1, 3, 0, 2, 4]


def test_counting_and_decaying_filters_take_back(spark):
    cells = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "tid long, cell string")
    made = bloom.counting(cells, 512, 3)
    asked = cells.distinct()
    less = bloom.removed(made, spark.createDataFrame([(1, "a"), (2, "x")], "tid long, cell string"), 512, 3)
    count = lambda f: {(r.tid, r.cell): r["count"] for r in bloom.counted(f, asked, 512, 3).collect()}
    assert count(made) == {(1, "a"): 2, (1, "b"): 1, (2, "c"): 1} and count(less) == {(1, "a"): 1, (1, "b"): 1, (2, "c"): 1}
    timed = bloom.decaying(cells.withColumn("time", F.when(F.col("cell") == "a", 5).otherwise(9)), 512, 3, 10)
    left = {r.tid: set(r.bits) for r in bloom.alive(timed, 16).collect()}
    b = set(spark.range(1).select(bloom.md5_positions(F.lit("b"), 512, 3)).first()[0])
    assert left[1] == b and set(left) == {1, 2}


def test_empty_summary_and_smaller_filters(spark):
    df = spark.createDataFrame([(1, [1, 65, 130]), (2, [])], "tid long, bits array<int>")
    rows = df.select(bloom.empty(F.col("bits")), bloom.summary(F.col("bits"), 192), bloom.folded(F.col("bits"), 192, 64)).collect()
    assert [(r[0], tuple(r[1]), r[2]) for r in rows] == [(False, (192, 3), [1, 2]), (True, (192, 0), [])]
    assert [tuple(r) for r in bloom.resized(df).orderBy("tid").collect()] == [(1, 0, []), (2, 0, [])]
    with pytest.raises(ValueError):
        bloom.folded(F.col("bits"), 192, 50)


def test_missing_singular_values(spark):
    entries = encodings.one_hot(spark.createDataFrame([(1, "ABAB"), (2, "AABBA")], "tid long, code string"), 2)
    rows = encodings.singular_profile(entries, 4, na_rm=False).collect()
    got = {t: [r.value for r in sorted(rows, key=lambda r: r["rank"]) if r.tid == t] for t in (1, 2)}
    assert got == {1: [None] * 4, 2: [0.25] * 4}


def _one_pass(bits, limit):
    leaders, found = [], {}
    for tid in sorted(bits):
        found[tid] = next((x for x in leaders if len(bits[x] ^ bits[tid]) < limit), tid)
        leaders += [tid] * (found[tid] == tid)
    return found


@pytest.mark.parametrize(("m", "share", "limit"), [(64, 0.95, 14), (64, 0.5, 14), (200, 0.2, 3), (64, 0.1, 1)])
def test_leaders_of_near_and_far_filters_without_pairs(spark, monkeypatch, m, share, limit):
    """Several rounds, and no table with more rows than there are filters: near pairs of 400 filters are up to 79,800."""
    monkeypatch.setattr(bloom, "ROUND", 40, raising=False)
    rng = np.random.default_rng(9)
    bits = {3 * i - 50: set(np.flatnonzero(rng.random(m) < share).tolist()) for i in range(400)}
    bits |= {2000: set(), 2001: set(), 2002: bits[-50], 2003: set(range(m))}
    rows, keep = [], storage.materialise
    monkeypatch.setattr(storage, "materialise", lambda df, label: (made := keep(df, label), rows.append(made.count()))[0])
    made = spark.createDataFrame([(t, sorted(b)) for t, b in bits.items()], "tid long, bits array<int>")
    assert dict(map(tuple, bloom.leader_classes(made, limit, m).collect())) == _one_pass(bits, limit)
    assert max(rows) <= len(bits)
