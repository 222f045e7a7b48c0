import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from wayline.llm import nearest, queries


def brute(vectors, asked, k):
    ok = {i: v for i, v in vectors.items() if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in asked:
        if q in ok:
            a = np.array(ok[q], float)
            scored = sorted((float(np.sqrt(((np.array(v, float) - a) ** 2).sum())), i) for i, v in ok.items() if i != q)
            out[q] = [(i, s) for s, i in scored[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_curve_steps_are_neighbours():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        keys = nearest.hilbert(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = brute(vectors, [i for i in vectors if i % 100 == 0], 10)
    found = got(queries.op3_nearest(spark, sf))
    assert set(found) == set(want) and all(len(x) == 10 for x in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(exact[q, i] - s) < 1e-12 for q in found for i, s in found[q] if (q, i) in exact)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=4).tolist() for i in range(150)}
    vectors |= {i: [1.0, 2.0, 3.0, 4.0] for i in range(200, 240)}
    vectors |= {300: None, 301: [0.0] * 4, 302: [1.0, None, 0.0, 0.0], 303: [float("nan"), 1.0, 1.0, 1.0], 304: [float("inf"), 1.0, 1.0, 1.0], 305: []}
    df = spark.createDataFrame([(i, v, 0.1, 1) for i, v in vectors.items()], "vec_id long, embedding array<double>, score double, rank int")
    df = df.union(spark.createDataFrame([(306, [1.0, 2.0], 0.1, 1), (None, [1.0, 2.0, 3.0, 4.0], 0.1, 1)], df.schema))
    asked = [0, 7, 200, 201, 239, 301, 303]
    assert got(nearest.nearest(df, F.col("vec_id").isin(asked))) == brute(vectors, asked, 10)
    two = df.where("vec_id IN (0, 1)")
    assert got(nearest.nearest(two, F.col("vec_id") == 0)) == brute({i: vectors[i] for i in (0, 1)}, [0], 10)
    assert nearest.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def recall(spark, have, asked, **options):
    """Share of the true ten neighbours found, and the rows on either side that a window has."""
    df = spark.createDataFrame(list(enumerate(have.tolist())), "vec_id long, embedding array<float>").repartition(8)
    have, sides, real = have.astype(np.float32).astype(float), [], nearest.window_rows
    nearest.window_rows = lambda *a: sides.append(real(*a)) or sides[-1]
    try:
        found = got(nearest.nearest(df, F.col("vec_id") % 100 == 0, **options))
    finally:
        nearest.window_rows = real
    hits = 0
    for q in asked:
        d = ((have - have[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10]) & {i for i, _ in found[q]})
    return hits / (10 * len(asked)), sides[0]


def test_recall_and_windows_at_forty_thousand(spark):
    """Spread evenly over a sphere, the hardest case; and in clusters, where windows must not grow with the table."""
    rng = np.random.default_rng(4)
    even = rng.normal(size=(40_000, 64))
    even /= np.linalg.norm(even, axis=1)[:, None]
    assert recall(spark, even, range(0, 40_000, 400))[0] >= 0.9
    sides = []
    for n in (5_000, 40_000):
        centres = rng.normal(size=(n // 50, 64))
        clustered = centres[rng.integers(0, len(centres), n)] + rng.normal(0, 0.15, (n, 64))
        share, side = recall(spark, clustered, range(0, n, 400))
        assert share >= 0.9
        sides.append(side)
    assert sides[1] / 40_000 < sides[0] / 5_000 / 2


def test_a_tight_cluster_and_a_giant(spark):
    """A third of the rows within a hair of each other, and one vector of huge norm."""
    rng = np.random.default_rng(8)
    have = rng.normal(size=(20_000, 32))
    have[:6_600] = have[0] + rng.normal(0, 0.02, (6_600, 32))
    have[19_999] *= 1e6
    assert recall(spark, have, range(0, 20_000, 400))[0] >= 0.9
