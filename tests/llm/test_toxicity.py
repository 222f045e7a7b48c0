import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import queries, simhash, toxicity
from wayline.llm.sampling import bounded

SF = "/root/testdata/sf0.1"


def test_held_out_quality(spark):
    got = queries.op6_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(F.sum(F.expr("predicted * toxic")).alias("tp"), F.sum("predicted").alias("p"), F.sum("toxic").alias("t")).first()
    assert r.tp / r.p > 0.85 and r.tp / r.t > 0.8


def test_odd_texts_and_tables(spark):
    rng = np.random.default_rng(2)
    plain = [" ".join(rng.choice(["sun", "moon", "tree", "sky"], 12)) for _ in range(60)]
    rude = [p + " rotten fool" for p in plain[:30]]
    rows = [(i, t, int(i >= 60), "en", 3) for i, t in enumerate(plain + rude)] + [(200, None, 0, None, 3), (201, "", None, "en", 3), (202, "!!", 1, "de", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string, score int")
    model = toxicity.fit(df, df)
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "rotten fool"), (4, "sun " * 40000), (5, "fool"), (6, "sun moon"), (7, "sun moon")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(texts, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert got[1] == got[2] and got[6] == got[7] and got[3] > got[6]
    assert toxicity.fit(df, df.limit(0)) is None and toxicity.fit(df, df.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(texts, None).collect()} == {0.0}
    flags = toxicity.score(texts.withColumn("lang", F.lit("en")), model, lang_col="lang")
    assert flags.where("over_threshold <> (score >= threshold)").count() == 0


def test_samples_hold_whole_texts(spark, monkeypatch):
    rows = [(i, f"sun{i} " * 3000 + "fool" * (i % 2), i % 2, "en") for i in range(80)]
    df = spark.createDataFrame(rows + rows[:40], "doc_id long, text string, toxic int, lang string")
    seen = {}
    monkeypatch.setattr(toxicity, "train", lambda ids, labels, langs: seen.update(ids=ids, labels=labels))
    toxicity.fit(df, df)
    assert sorted(zip(map(len, seen["ids"]), seen["labels"])) == [(3000, 0)] * 40 + [(3001, 1)] * 40
    held = spark.createDataFrame([(i, 3000) for i in range(80)], "key long, words long")
    assert 10 < bounded(held, "key", "words", 100_000).count() < 60 and bounded(held, "key", "words", 240_000).count() == 80


def _packed(texts):
    words = toxicity.Words()
    return [words.rows[i] for i in words.ids(texts)]


def test_late_insults_teach():
    rng = np.random.default_rng(5)
    plain = [" ".join(rng.choice(["sun", "moon", "tree", "sky", "river"], 1700)) for _ in range(40)]
    texts = [p + " rotten fool" * (i % 2) for i, p in enumerate(plain)]
    model = toxicity.train(_packed(texts), [i % 2 for i in range(40)], ["en"] * 40, steps=40, batch=8)
    got = toxicity.Scorer(model).score(texts)
    assert all((s >= 0.7) == bool(i % 2) for i, s in enumerate(got))


def test_scores_equal_a_slow_forward_pass():
    """Every window of every width by plain loops, from the same weights."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["sun", "Moon", "été", "rotten", "fool", "x1"], n)) for n in (0, 1, 2, 3, 7, 40)] + [None, "  !! "]
    model = toxicity.train(_packed(texts * 6), [i % 2 for i in range(48)], ["en"] * 48, steps=30, batch=8)
    got = toxicity.Scorer(model).score(texts)
    for text, score in zip(texts, got):
        words = [model["emb"][r].astype(float).sum(axis=0) for r in _packed([text])[0]]
        hidden = []
        for w in toxicity.WIDTHS:
            short = 0 < len(words) < w  # every word of a short text begins a window, filled up with nothing
            filled = words + [0 * words[0]] * (w - 1) if short else words
            windows = [sum(filled[i + k] @ model[f"f{w}"][k] for k in range(w)) for i in range(len(filled) - w + 1)]
            hidden += list(np.max(windows, axis=0) + model[f"b{w}"] if windows else model[f"b{w}"])
        logit = np.maximum(hidden, 0) @ model["out"] + model["bias"][0]
        assert score == pytest.approx(1 / (1 + np.exp(-(logit / model["heat"] + model["shift"]))), abs=1e-9)


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_windows_never_cross_texts(n):
    sizes = np.array([n, 3, 0, 1])
    flat = np.arange(sizes.sum(), dtype=float)[:, None]
    best, _ = toxicity._pooled([flat, 10 * flat], sizes, 2, np.zeros(1))
    want, at = [], 0
    for size in sizes:
        x = flat[at : at + size, 0]
        at += size
        want.append(max((x[i] + 10 * x[i + 1] for i in range(size - 1)), default=x[0] if size else 0.0))
    assert best[:, 0].tolist() == want


def test_every_labelled_row_teaches(spark):
    """More rows than are taught at once: a toxic word of a single row still counts, and thresholds count all rows kept out."""
    rng = np.random.default_rng(3)
    plain = [" ".join(rng.choice(["sun", "moon", "tree", "sky"], 12)) for _ in range(600)]
    texts = [f"{p} {'rotten fool' if i % 3 == 0 else 'kind friend'} only{i}" for i, p in enumerate(plain)]
    df = spark.createDataFrame([(i, t, int(i % 3 == 0), "en") for i, t in enumerate(texts)], "doc_id long, text string, toxic int, lang string")
    model = toxicity.fit(df.union(df), df, part_rows=150)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all((s >= 0.7) == (i % 3 == 0) for i, s in got.items())
    fresh = toxicity.beginning(np.zeros(toxicity.TABLE), 8, 6, np.random.default_rng(11))["emb"][:, 0].astype(np.float32)
    words = toxicity.Words()
    own = [words.rows[words.ids([f"only{i}"])[0][0]][0] for i in range(600)]
    assert np.mean(model["emb"][own, 0] != 0) > 0.7 and (fresh == 0).all()
    assert toxicity.fit(df, df.where("toxic = 0"), part_rows=150) is None


def _shuffled(spark, act):
    """What act() gives, and the bytes that its stages have shuffled."""
    sc = spark.sparkContext
    args = (None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(*args)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    return act(), sum(v for k, v in written().items() if k not in before)


def test_shuffles_keep_in_proportion_to_the_input(spark):
    """Where the labels are too many to be broadcast, texts meet them by a shuffle; taken together no more is moved then than for fewer labels."""
    rng = np.random.default_rng(9)
    words = [[f"{x:016x}" for x in rng.integers(0, 1 << 62, 1000)] + ["rotten" if i % 3 == 0 else "kind"] for i in range(600)]
    rows = [(i, " ".join(w), int(i % 3 == 0), "en") for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    name = "spark.sql.autoBroadcastJoinThreshold"
    was, got = spark.conf.get(name), []
    try:
        for limit in ("10m", "-1"):
            spark.conf.set(name, limit)
            got.append(_shuffled(spark, lambda: toxicity.fit(df.union(df), df.select("doc_id", "toxic"), part_rows=150)))
    finally:
        spark.conf.set(name, was)
    (few, moved), (many, more) = got
    assert few["shift"] == pytest.approx(many["shift"]) and np.allclose(few["emb"], many["emb"])
    assert moved > 5e6 and more < 1.15 * moved


def test_filters_grow_with_the_rows_wanted(spark):
    ids = spark.range(1 << 22).withColumnRenamed("id", "doc_id")
    wanted = ids.where("doc_id % 2 = 0")
    kept = simhash.likely(ids, wanted, wanted.count())
    assert kept.where("doc_id % 2 = 0").count() == 1 << 21 and kept.count() < 1.1 * (1 << 21)
