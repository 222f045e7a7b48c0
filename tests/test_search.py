"""Waves and searches against the whole table and against measuring everything."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import trajectories as tr
from wayline.operators import frechet, search, wavefront


def table(u, v, add, band=None):
    """The last cell of the coupling table, cell by cell."""
    width = math.inf if band is None else max(band, abs(len(u) - len(v)))
    cells = {}
    for i, p in enumerate(u):
        for j, q in enumerate(v):
            d = math.dist(p, q) if abs(i - j) <= width else math.inf
            before = [cells[c] for c in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if c in cells]
            best = min(before) if before else 0.0
            cells[i, j] = best + d if add else max(best, d)
    return cells[len(u) - 1, len(v) - 1]


def curves(rng, n, longest=25):
    return [np.cumsum(rng.normal(0, 1, (rng.integers(1, longest), 2)), axis=0) for _ in range(n)]


@pytest.mark.parametrize("together", [1, 60, 1 << 18])
def test_waves_equal_the_table(monkeypatch, together):
    monkeypatch.setattr(wavefront, "TOGETHER", together)
    rng = np.random.default_rng(together)
    us, vs = curves(rng, 60), curves(rng, 60)
    assert wavefront.coupled(us, vs) == pytest.approx([table(u, v, False) for u, v in zip(us, vs)])
    assert wavefront.coupled(us, vs, "warping") == pytest.approx([table(u, v, True) for u, v in zip(us, vs)])
    assert wavefront.coupled(us, vs, "warping", band=3) == pytest.approx([table(u, v, True, 3) for u, v in zip(us, vs)])
    whole = wavefront.coupled(us, vs)
    for limit in (0.5, 3.0, 6.0):
        some = wavefront.coupled(us, vs, limit=limit)
        assert ((some == whole) | (np.isinf(some) & (whole > limit))).all()


def test_empty_and_null_trajectories_and_the_column_form(spark):
    rows = [(1, [(0.0, 0.0), (1.0, 1.0)], [(0.0, 1.0)]), (2, [], [(1.0, 1.0)]), (3, [(1.0, 1.0)], []), (4, None, None), (5, [(float(i), 0.0) for i in range(30)], [(float(i), 2.0) for i in range(9)])]
    df = spark.createDataFrame(rows, "id long, u array<struct<x: double, y: double>>, v array<struct<x: double, y: double>>")
    got = {r.id: r.distance for r in wavefront.distances(df, "id").collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and got[3] is None and got[4] == 0.0
    plain = {r.id: r.d for r in df.where("id IN (1, 5)").select("id", tr.discrete_frechet(F.col("u"), F.col("v")).alias("d")).collect()}
    assert all(got[i] == pytest.approx(plain[i]) for i in plain)
    assert wavefront.distances(df.limit(0), "id").count() == 0


@pytest.fixture
def database(spark):
    rng = np.random.default_rng(17)
    made = [c + rng.normal(0, 4, 2) for c in curves(rng, 120, 12)]
    made[7] = made[3].copy()
    made[8] = made[3].copy()
    rows = [(i, [(float(x), float(y)) for x, y in c]) for i, c in enumerate(made)] + [(500, [])]
    return made, spark.createDataFrame(rows, "tid long, pts array<struct<x: double, y: double>>").repartition(5)


def brute(made, tid, continuous):
    if continuous:
        form = lambda c: np.concatenate([c, c]) if len(c) == 1 else c
        return sorted((frechet.bisect(form(made[tid]), form(c), search.TOLERANCE), i) for i, c in enumerate(made) if i != tid)
    return sorted((table(c, made[tid], False), i) for i, c in enumerate(made) if i != tid)


@pytest.mark.parametrize("continuous", [False, True])
def test_searches_equal_measuring_everything(database, continuous):
    made, db = database
    want = brute(made, 3, continuous)
    for k in (1, 5, 200):
        got = [(r.distance, r.tid) for r in search.nearest(db, 3, k, continuous).collect()]
        assert [t for _, t in got] == [t for _, t in want[:k]] and [d for d, _ in got] == pytest.approx([d for d, _ in want[:k]])
    radius = want[20][0]
    got = {r.tid for r in search.within(db, 3, radius, continuous).collect()}
    assert got == {t for d, t in want if d <= radius}


def test_bounds_are_below_the_distances(database):
    made, db = database
    rows, query = search._bounded(db, 3)
    for r in rows.collect():
        curve = np.array([(p["x"], p["y"]) for p in r.pts])
        form = np.concatenate([curve, curve]) if len(curve) == 1 else curve
        assert r.bound <= frechet.bisect(form, search._curve(query), 1e-6) + 1e-9
