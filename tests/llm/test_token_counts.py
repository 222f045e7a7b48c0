import json
import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayline.llm import queries
from wayline.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "it's  a\n\ntest", "x'll y'd", "<|endoftext|> hi", "éü中文😀½²٣\x1c", "a" * 50_000, "word " * 3000, "it's  a\n\ntest"]


def test_counts_equal_the_library(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string, counts int")
    got = {r.doc_id: r for r in tc.count_tokens(df, PATH).collect()}
    library = Tokenizer.from_file(PATH)
    for i, t in enumerate(TEXTS):
        want = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want, len((t or "").encode()), want > 1024)


def test_prefixes_answer_truncation(spark):
    df = spark.createDataFrame([(0, "the quick brown fox jumps over the lazy dog " * 3)], "doc_id long, text string")
    text = df.first().text
    library = Tokenizer.from_file(PATH)
    counts = tc.prefix_counts(df, PATH).first().counts
    for i in range(1, len(text)):
        if not text[i - 1].isspace():
            assert counts[i] == len(library.encode(text[:i], add_special_tokens=False).ids)
    for limit in (1, 5, 9):
        n = tc.count_tokens(df, PATH, limit=limit).first().prefix_bytes
        assert counts[n] <= limit and all(c > limit for c in counts[n + 1 :])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tc.count_tokens(empty, PATH).where(F.col("n_tokens") > 0).count() == 0


def test_the_query_equals_the_library_on_every_document(spark):
    sf = "/root/testdata/sf0.01"
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op2_token_counts(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return tc.PrefixCounter(json.load(f))


def test_long_pieces_equal_short_steps(counter):
    rng = random.Random(3)
    for alphabet in ("a", "ab", "the ", "=-", "éü中文😀", "abcdefghijklmnopqrstuvwxyz"):
        piece = "".join(rng.choice(alphabet) for _ in range(150)).encode()
        assert counter.solve_long(piece).tolist() == counter.solve([piece])[0].tolist()


@pytest.mark.parametrize("alphabet", ["a", "ab", "=", "中文字", "abcdefghijklmnopqrstuvwxyz"])
def test_a_megabyte_without_a_gap(counter, alphabet):
    rng = random.Random(4)
    text = "".join(rng.choices(alphabet, k=1_000_000 // len(alphabet[0].encode())))
    began = time.perf_counter()
    counts = counter.solve([text.encode()])[0]
    assert time.perf_counter() - began < 60  # seconds here; hours if time grew with the square
    assert counts[-1] == len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)
