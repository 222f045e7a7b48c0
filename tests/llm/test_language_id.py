import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import language_id, queries, sampling


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.op1_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("accepted").cast("int")), F.count("*")).first()
    assert held[0] > 0.97 and held[1] > 0.97 and held[2] > 150
    assert got.where("score < 0 or score > 1").count() == 0 and got.count() == 1000


def test_odd_texts_and_columns(spark):
    texts = {1: "the cat and the dog", 2: None, 3: "", 4: "123 !? ²", 5: "und der die das", 6: "x" * 200_000, 7: "the cat and the dog", 8: "中文"}
    df = spark.createDataFrame([(i, t, "en" if i < 4 else "de", 0.5, True) for i, t in texts.items()], "doc_id long, text string, lang string, score double, accepted boolean")
    model = language_id.fit(df)
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert all((got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False) for i in (2, 3, 4))
    assert all(got[i].lang_pred in ("en", "de") for i in (1, 5, 6, 7, 8)) and got[1].score == got[7].score
    assert language_id.fit(df.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(df, None).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).count() == 0


def test_rejection_spares_clean_short_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    words = docs.select("doc_id", F.expr("array_join(slice(split(trim(text), '[ \\n]+'), 1, 6), ' ')").alias("text"))
    assert language_id.predict(words, model).agg(F.avg(F.col("accepted").cast("int"))).first()[0] > 0.97


def test_samples_are_drawn_over_whole_texts_of_every_label(spark):
    rows = [(i, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(5000)), f"l{i % 40}") for i in range(400)]
    df = spark.createDataFrame(rows + rows[:100], "doc_id long, text string, lang string")
    drawn = sampling.stratified(df, "lang", ["doc_id", "text"], 1500, 120).dropDuplicates(["key"]).groupBy("lang").count().collect()
    assert len(drawn) > 30 and 60 < sum(r[1] for r in drawn) < 200
    sample = language_id.pieces(sampling.stratified(df, "lang", ["doc_id", "text"], 1500, 12_000).withColumnRenamed("lang", "label"))
    assert sample.count() == 500 and sample.dropDuplicates(["key", "label"]).count() == 400
    sizes = sample.select(F.explode("parts").alias("p")).agg(F.max(F.length("p")), F.min(F.length("p"))).first()
    assert sizes[0] < 300 * 2 * 30 and sizes[1] > 0


def test_scores_equal_a_slow_forward_pass(spark):
    """Averages of table rows of all subwords, one by one, from the same weights."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    cutter = language_id.Subwords(model["table"])
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    for r in docs.collect():
        words = cutter.words(r.text)
        if not words:
            continue
        rows = np.concatenate([cutter.rows([w])[0] for w in words])
        z = (model["scores"][rows].astype(float).mean(axis=0) + model["bias"]) / model["heat"]
        p = np.exp(z - z.max())
        p /= p.sum()
        assert got[r.doc_id].score == pytest.approx(p.max(), abs=1e-6) and got[r.doc_id].lang_pred == model["names"][int(p.argmax())]
