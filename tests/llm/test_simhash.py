import itertools
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayline.llm import queries, simhash
from wayline.operators.graph import components


def brute_fingerprint(text, k=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in ids}


def test_values_two_bits_apart_share_a_key():
    code, rng = simhash.Golay(), np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 400)
    kx = code.keys(x)
    for a, b in itertools.combinations_with_replacement(range(23), 2):
        y = x ^ (1 << a) ^ (0 if a == b else 1 << b)
        ky = code.keys(y)
        shared = ((kx[:, :, None] == ky[:, None, :]) & (kx[:, :, None] >= 0)).any(axis=(1, 2))
        assert shared.all()


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = {d.doc_id: brute_fingerprint(d.text) for d in docs}
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize("crowd", [2, 48])
def test_links_of_close_values(spark, crowd):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 6)
    values = {int(b) for b in base}
    for b in base:
        x = int(b)
        for _ in range(25):
            for bit in rng.integers(0, 63, rng.integers(1, 4)):
                x ^= 1 << int(bit)
            values.add(x)
    prints = dict(enumerate(sorted(values)))
    df = spark.createDataFrame([(v, i) for i, v in prints.items()], "fp long, node long")
    found = {r.node: r.component for r in components(simhash.links(df, crowd)).collect()}
    want = brute_components({i: v & (1 << 64) - 1 for i, v in prints.items()})
    assert {i: found.get(i, i) for i in prints} == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "ONE"), (7, "a b"), (8, "x " * 30000), (9, "é\x0bü")]
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id long, text string, key string, fp int, node int")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert {i: got[i].fp & (1 << 64) - 1 for i, _ in rows} == {i: brute_fingerprint(t) for i, t in rows}
    assert [got[i].component_id for i in (1, 2, 3)] == [1, 1, 1] and [got[i].component_id for i in (4, 5, 6)] == [4, 4, 4]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    df = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in components(df).collect()} == {0}
