import random

import numpy as np
import pytest
import regex

from wayline.llm import decontamination as dc
from wayline.llm import queries


def words(text):
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())


def brute(pattern, text, k):
    """The smallest distance of the pattern to any stretch of the text, and the first end that has it."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    best = min(row[1:], default=len(pattern))
    return (best, row[1:].index(best)) if text and best <= k else None


def expected(docs, items):
    return expected_words({d: words(t) for d, t in docs.items()}, {i: words(t) for i, t in items.items()})


def expected_words(docs, items, rate=dc.RATE):
    """By the whole table of edit distances; documents that share too few words with an item to hold it are passed over."""
    out = {}
    for d, text in docs.items():
        have = set(text)
        for i, w in items.items():
            k = int(len(w) * rate)
            if w and sum(x not in have for x in w) <= k and (found := brute(w, text, k)):
                out[d, i] = found
    return out


def got(df):
    return {(r.doc_id, r.item_id): (r.distance, r.last_word) for r in df.collect()}


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_edited_passages(spark, block_bytes):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["É", "été", "ß", "Привет", "ΩΜΕΓΑ", "中文"]
    items = {i: " ".join(rng.choice(vocab) for _ in range(n)) for i, n in enumerate([5, 6, 9, 13, 20, 31, 47, 64, 90])}
    items |= {50: None, 51: "", 52: "w1 w2", 53: items[4]}
    docs = {}
    for d in range(120):
        w = items[d % 9].split()
        for _ in range(rng.randint(0, 2 + len(w) // 5)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 1)
        pad = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        docs[d] = "— ".join(pad).upper() + "\n" + " ".join(w) + "! " + " ".join(pad)
    docs |= {200: None, 201: "", 202: "w1 " * 3000, 203: items[8] + " " + items[8]}
    df = spark.createDataFrame([(d, t, 1, "i") for d, t in docs.items()], "doc_id long, text string, distance int, item_id string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = expected(docs, {i: t for i, t in items.items() if t})
    assert len(want) > 60 and got(dc.leaks(df, bench, block_bytes=block_bytes)) == want
    kept = {r.doc_id for r in dc.clean(df, bench, block_bytes=block_bytes).collect()}
    assert kept == set(docs) - {d for d, i in want if len(words(items[i])) >= dc.LEAST_WORDS}
    marked = dc.leaks(df, bench, block_bytes=block_bytes).where("short").select("item_id").distinct().collect()
    assert [r[0] for r in marked] == [52]


def test_places(spark):
    df = spark.createDataFrame([(1, "x y a b c d e f z"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f")], "item_id long, text string")
    r = dc.leaks(df, bench).first()
    assert (r.distance, r.first_word, r.last_word) == (0, 2, 7)
    assert dc.leaks(df, bench.limit(0)).count() == 0 and dc.leaks(df.limit(0), bench).count() == 0


def test_query_finds_what_plain_search_finds(spark, sf_dir):
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    found = got(queries.op4_decontamination(spark, sf_dir))
    assert found == {pair: hit for pair, hit in expected_words(docs, items).items()}
    exact = {(d, i) for d, w in docs.items() for i, p in items.items() if f" {' '.join(p)} " in f" {' '.join(w)} "}
    assert exact and exact == {pair for pair, (distance, _) in found.items() if distance == 0}


def test_distance_of_a_whole_word_array():
    rng = np.random.default_rng(0)
    for _ in range(50):
        p, t = rng.integers(0, 4, rng.integers(1, 90)).tolist(), rng.integers(0, 4, 60).tolist()
        best, end = brute(p, t, 10**6)
        scores = list(dc.Distance(p).ends(t))
        assert (min(scores), scores.index(min(scores))) == (best, end)


def test_long_words_that_differ(spark):
    morse = "a"
    for _ in range(11):
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    items = spark.createDataFrame([(1, f"{morse} one two three four")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {other} one two three four"), (2, f"x {morse} one two three four")], "doc_id long, text string")
    found = {r.doc_id for r in dc.leaks(docs, items).collect()}
    assert found == {2}
