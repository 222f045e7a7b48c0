import itertools
import random
import re

import numpy as np

from wayline.llm import simhash


def shingles(text, k=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(texts, similarity=0.8):
    """Connected components of the pairs as similar as asked, by comparing all."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x == y or x and y and len(x & y) >= similarity * len(x | y):
            r, s = sorted((root(a), root(b)))
            parent[s] = r
    return {i: root(i) for i in texts}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"z{rng.randrange(999)}"
    return " ".join(out)


def test_classes_equal_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(400)]
    texts, i = {}, 0
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 300))]
        for n in (0, 0, 1, 2, 60):
            texts[i] = edited(rng, base, n)
            i += 1
    texts |= {1000: None, 1001: "", 1002: "  ", 1003: "one two", 1004: "ONE two", 1005: "one", 1006: "r " * 40_000}
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, node int, segments string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    want = classes(texts)
    assert got == want
    kept = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert kept == {i for i in texts if got[i] == i}
    assert simhash.similar_documents(df.limit(0)).count() == 0


def test_crowded_keys(spark):
    rng = random.Random(2)
    base = [f"v{rng.randrange(300)}" for _ in range(200)]
    texts = {i: edited(rng, base, 1) for i in range(150)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.component_id for r in simhash.similar_documents(df, crowd=8).collect()} == {0}


def same_as_brute_force(spark, texts, **options):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df, **options).collect()}
    want = classes(texts)
    assert got == want
    return want


def test_every_similar_pair_is_found(spark):
    """Appended blocks, cut ends, repeated lines and short texts near 0.8: recall 1 against brute force."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]

    def words(n):
        return [rng.choice(vocab) for _ in range(n)]

    texts, i = {}, 0
    for _ in range(25):
        long, short, line, common = words(300), words(40), words(10), words(100)
        for w in (long, long + words(74), long[:242], short, short + words(8), short + words(10), common + line, common + line * 100, words(6), line, line[:9] + words(1)):
            texts[i] = " ".join(w)
            i += 1
    texts |= {i + j: " ".join(["y"] * j) for j in range(12)}
    want = same_as_brute_force(spark, texts)
    assert sum(want[j] != j for j in texts) >= 100


def test_sketches_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 900):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 10).astype(np.uint64)])
        assert np.bitwise_count(simhash._sketch(a) ^ simhash._sketch(b)).sum() <= len(np.setxor1d(a, b))


def test_crowded_keys_hide_no_family(spark):
    """Many small families and chains that share most of their text, but not enough to be similar: none is left apart."""
    rng = random.Random(6)
    shared = [f"v{rng.randrange(300)}" for _ in range(120)]
    texts, i = {}, 0
    for f in range(30):
        own = [f"f{f}w{j}" for j in range(45)]
        for more in (0, 34, 68, 102):  # neighbours in the chain are similar, the others are not
            texts[i] = " ".join(shared + own + [f"m{f}x{j}" for j in range(more)])
            i += 1
    small = same_as_brute_force(spark, texts, crowd=8)
    assert sum(small[j] != j for j in texts) == 90
    assert len({small[j] for j in texts}) == 30


def test_long_words_that_differ(spark):
    morse = "a"
    for _ in range(11):
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    texts = {1: f"{morse} b c d e", 2: f"{other} b c d e", 3: f"{morse} b c d e"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_long_unlike_texts_are_not_compared(spark):
    """Long texts with some passages in common: their sketches alone tell that they are apart, so their shingles stay where they are."""
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(60)]
    texts = {i: " ".join([f"t{i}x{j}" for j in range(2000 + 300 * i)] + shared) for i in range(4)}
    base = texts[0].split()
    texts |= {10: texts[0] + " " + " ".join(f"u{j}" for j in range(480)), 11: edited(rng, base, 12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    nodes = simhash._outlines(df, 5).withColumnRenamed("doc_id", "node").localCheckpoint()
    pairs = spark.createDataFrame(list(itertools.combinations(sorted(texts), 2)), "src long, dst long")
    assert {tuple(r) for r in simhash._near(nodes, pairs, 0.8).collect()} <= {(0, 10), (0, 11), (10, 11)}
    same_as_brute_force(spark, texts)


def test_fine_sketches_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(4)
    for n, more in ((600, 0), (1000, 200), (2000, 100), (4000, 900)):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 10 + more).astype(np.uint64)])
        assert 0 < simhash._apart(simhash._fine(a), simhash._fine(b)) <= len(np.setxor1d(a, b))


def test_every_wanted_text_is_found(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(-300, 300)] + [(5, "again"), (7, None)], "doc_id long, text string")
    wanted = df.where("doc_id % 7 = 0").select("doc_id").distinct()
    got = simhash._texts_of(df, wanted)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, df.where("doc_id % 7 = 0").collect()))
