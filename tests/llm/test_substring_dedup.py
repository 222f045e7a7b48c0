import hashlib
import re

import pytest

from wayline.llm import queries, substring_dedup


def brute(docs, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs.items()}
    smallest = {}
    for i in sorted(words):
        for a in range(len(words[i]) - window + 1):
            smallest.setdefault(tuple(words[i][a : a + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for a in range(len(w) - window + 1):
            if smallest[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def rows(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_query_equals_brute_force(spark, sf_dir):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute(docs, 50)
    assert sum(n > 0 for _, n, _ in want.values()) > 0
    assert rows(queries.op5_substring_dedup(spark, sf_dir)) == want


@pytest.mark.parametrize("bucket_words", [40, 400, 10**6])
def test_small_windows_hot_minimisers_and_odd_texts(spark, bucket_words):
    shared = "a b c d e f g h i j k l"
    docs = {i: f"{i} x{i} {shared}\t{shared} y{i}\n z" for i in range(60)}
    docs |= {100: None, 101: "", 102: " \n", 103: "a b c", 104: "q " * 500, 105: "q " * 500, 106: shared, 107: shared.upper(), 108: "é ü\x0b" + shared}
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in docs.items()], "doc_id long, text string, first int, spans string")
    got = rows(substring_dedup.remove_repeats(df, window=6, run=2, bucket_words=bucket_words))
    assert got == brute(docs, 6)


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def morse(n):
    """The word of 2**n letters and its complement that polynomial hashes modulo 2**64 take for one."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [6, 10, 12])
def test_words_that_polynomials_take_for_each_other(spark, n):
    tail = " ".join(f"w{i}" for i in range(49))
    docs = {1: f"{morse(n)[0]} {tail}", 2: f"{morse(n)[1]} {tail}", 3: f"{morse(n)[0]} {tail}"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = rows(substring_dedup.remove_repeats(df))
    assert got == brute(docs, 50) and got[2][1] == 0 and got[3][1] == 50
