import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from wayline.llm import fill_middle, queries

TEXTS = [None, "", "a", "A b", "😀", "x😀ýz é", "\n\r\n \x85", "a<P>b", "<S>", "x <M>", "<<P >S>", "word " * 3000, "abc" * 5000, "tail.\n", "tail.\n", "ÄÖ ab\x00c", "<S", "S>"]
GRAMMARS = {"token": r"[A-Za-z]+|[^A-Za-z]", "char": r"(?s).", "word": r"\S+|\s+", "line": r"[^\n]*\n|[^\n]+"}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def slow(doc, text):
    """The contract, step by step: (n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"1:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_every_text_equals_the_plain_steps_and_comes_back(spark):
    rng = random.Random(3)
    texts = TEXTS * 8 + ["".join(rng.choices("ab<>PSM \n😀é", k=rng.randrange(30))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "y", 2)], "doc_id long, text string, output string, n int")
    made = fill_middle.transform(df).withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    assert len(made) == len(texts) + 1 and {r.form for r in made} == {"plain", "psm", "spm"}
    for r in made:
        text = "no id" if r.doc_id is None else texts[r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == slow(r.doc_id, text)
        assert r.back == (text or "")
    assert fill_middle.transform(df.limit(0)).count() == 0


def test_boundaries_cut_as_the_grammars_match(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for name, pattern in GRAMMARS.items():
        # Java's \s is the ASCII white space
        plain = re.compile(pattern.replace(r"\S", r"[^ \t-\r]").replace(r"\s", r"[ \t-\r]"))
        for r in df.select("text", fill_middle.units(F.col("text"), name).alias("u")).collect():
            assert r.u == plain.findall(r.text or ""), (name, r.text)
    got = df.select(fill_middle.units(F.lit("ab12-cd"), ["a-z", "0-9"])).first()[0]
    assert got == ["ab", "12", "-", "cd"]


def test_query_equals_the_plain_steps_and_sql(spark, sf_dir):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op11_fill_middle(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, prefix, middle, output = slow(r.doc_id, docs[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, prefix, middle, sha(output), sha(docs[r.doc_id] or ""))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    asked = con.execute(queries.ORACLES["op11_fill_middle"])
    assert [d[0] for d in asked.description] == list(rows[0].asDict())
    assert sorted(map(tuple, rows)) == sorted(asked.fetchall())


def test_only_native_operators(spark, sf_dir):
    plan = queries.op11_fill_middle(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Exchange"))
