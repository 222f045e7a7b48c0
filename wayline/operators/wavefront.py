"""Couplings of two trajectories' vertices by waves of anti-diagonals: discrete Fréchet distance and time warping.

The cells of one anti-diagonal of the coupling table depend only on the two before it, so a wave works
out a whole one at once, for all pairs of a batch that are about as long. Two waves are kept, never a
table: memory grows with the shorter trajectory. Lower bounds by ends and extents tell beforehand
which pairs cannot be within a distance, and a wave that has passed the distance everywhere stops.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of the waves of pairs that go together, at most.
TOGETHER = 1 << 18


def _points(column: pa.ListArray) -> list[np.ndarray]:
    """Each trajectory of a column of arrays of (x, y) as a matrix; null: none."""
    flat = column.flatten()
    xy = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")]) if len(flat) else np.zeros((0, 2))
    ends = np.cumsum([n or 0 for n in column.value_lengths().to_pylist()])
    return np.split(xy, ends[:-1]) if len(ends) else []


def _apart(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    d = u - v
    return np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1])


def _wave(us, vs, step, band=None, limit=np.inf) -> np.ndarray:
    """The last cells of pairs of trajectories, none empty, that go together; infinite where a wave has passed the limit everywhere."""
    n, m = np.array([len(u) for u in us]), np.array([len(v) for v in vs])
    u, v = np.zeros((len(us), n.max(), 2)), np.zeros((len(vs), m.max(), 2))
    for i, (a, b) in enumerate(zip(us, vs)):
        u[i, : len(a)], v[i, : len(b)] = a, b
    width = None if band is None else np.maximum(band, np.abs(n - m))[:, None]
    rows = n.max()
    before, last = (np.full((len(us), rows + 1), np.inf) for _ in range(2))  # column i + 1 is row i of the table
    out, open_ = np.full(len(us), np.inf), np.arange(len(us))
    for k in range(n.max() + m.max() - 1):
        lo, hi = max(0, k - m.max() + 1), min(rows - 1, k)
        i = np.arange(lo, hi + 1)
        cost = _apart(u[:, i], v[:, k - i])
        if width is not None:
            cost = np.where(np.abs(2 * i - k) <= width, cost, np.inf)
        best = np.minimum(np.minimum(last[:, i], last[:, i + 1]), before[:, i]) if k else np.zeros((len(u), 1))
        now = np.full(last.shape, np.inf)
        now[:, i + 1] = step(best, cost)
        ends = np.flatnonzero(n + m - 2 == k)
        out[open_[ends]] = now[ends, n[ends]]
        left = n + m - 2 > k
        if limit < np.inf:  # a coupling goes by one of two waves in a row
            left &= np.minimum(now, last).min(axis=1) <= limit
        before, last = last, now
        if not left.all():
            u, v, n, m, before, last, open_ = u[left], v[left], n[left], m[left], before[left], last[left], open_[left]
            width = None if width is None else width[left]
            if not len(n):
                break
    return out


def coupled(us: list[np.ndarray], vs: list[np.ndarray], kind: str = "frechet", band: int | None = None, limit: float = np.inf) -> np.ndarray:
    """The distance of each pair: `frechet`, the smallest leash, or `warping`, the smallest sum, within a band if one is given.

    0 where u is empty for the leash, not a number where only v is; infinite where it is known to be above `limit`.
    """
    step = {"frechet": np.maximum, "warping": np.add}[kind]
    n, m = np.array([len(u) for u in us], int), np.array([len(v) for v in vs], int)
    out = np.where((n == 0) & (kind == "frechet"), 0.0, np.nan)
    full = np.flatnonzero((n > 0) & (m > 0))
    order = full[np.lexsort((m[full], n[full]))]
    while len(order):
        size = np.maximum.accumulate(n[order]) * np.arange(1, len(order) + 1)
        take = max(1, int(np.searchsorted(size, TOGETHER, side="right")))
        part, order = order[:take], order[take:]
        out[part] = _wave([us[i] for i in part], [vs[i] for i in part], step, band, limit)
    return out


def distances(pairs: DataFrame, keep: str, kind: str = "frechet", band: int | None = None, limit: float = np.inf) -> DataFrame:
    """(keep, distance) of pairs with columns u and v, arrays of points with x and y; null where it is not a number."""
    form = pairs.schema[keep].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = coupled(_points(batch.column("u")), _points(batch.column("v")), kind, band, limit)
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(found, pa.float64(), mask=np.isnan(found))], [keep, "distance"])

    ready = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias(c)
    return pairs.select(keep, ready("u"), ready("v")).mapInArrow(run, f"{keep} {form}, distance double")


def at_least(u: Column, v: Column) -> Column:
    """What the leash of two trajectories, discrete or continuous, is at least: their ends, and the sides of their extents, lie as far apart."""
    side = lambda pick, c: F.abs(pick(F.transform(u, lambda p: p[c])) - pick(F.transform(v, lambda p: p[c])))
    end = lambda k: F.sqrt(F.pow(F.element_at(u, k)["x"] - F.element_at(v, k)["x"], F.lit(2.0)) + F.pow(F.element_at(u, k)["y"] - F.element_at(v, k)["y"], F.lit(2.0)))
    return F.greatest(end(1), end(-1), *(side(pick, c) for pick in (F.array_min, F.array_max) for c in ("x", "y")))
