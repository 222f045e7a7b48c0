"""Searches of a database of trajectories by the discrete and the continuous Fréchet distance, without measuring all of it.

Bounds that take one look at each trajectory come first: its ends and extents tell how far it is at
least. The k with the smallest bounds are measured, which gives a radius; only trajectories whose
bound is within it are looked at again, in every task from the smallest bound on, and each task's
radius shrinks as it finds nearer ones. The query goes to all tasks, checked for its size; the
database is never shuffled.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frechet, wavefront
from .compare import query_row

#: How near the continuous distance is found.
TOLERANCE = 1e-6


def _curve(p: np.ndarray) -> np.ndarray:
    p = p[np.concatenate([[True], (np.diff(p, axis=0) != 0).any(axis=1)])]
    return np.concatenate([p, p]) if len(p) == 1 else p


def _bounded(db: DataFrame, tid) -> tuple[DataFrame, np.ndarray]:
    """(tid, pts, bound) of all others that have points, and the query's points."""
    row = query_row(db, tid)
    query = row.first().query_pts
    if not query:
        raise ValueError("the query has no points")
    others = db.where((F.col("tid") != tid) & (F.size("pts") > 0)).crossJoin(F.broadcast(row))
    others = others.select("tid", F.transform("pts", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("pts"), "query_pts")
    return others.withColumn("bound", wavefront.at_least(F.col("pts"), F.col("query_pts"))).drop("query_pts"), np.array([(p["x"], p["y"]) for p in query], float)


def _measured(rows: DataFrame, query: np.ndarray, radius: float, k: int | None, continuous: bool) -> DataFrame:
    """(tid, distance) of rows within the radius; with k, each task keeps only its k nearest, and its radius shrinks to them."""
    form = rows.schema["tid"].dataType.simpleString()
    curve = _curve(query)

    def run(batches):
        nearest: list[tuple[float, float]] = []  # the largest distance first
        kind = None
        for batch in batches:
            kind = batch.schema.field("tid").type
            bound, tids = batch.column("bound").to_numpy(), batch.column("tid").to_pylist()
            order = np.argsort(bound, kind="stable")
            points = wavefront._points(batch.column("pts"))
            step = 1 if continuous else 256
            for a in range(0, len(order), step):
                limit = -nearest[0][0] if k and len(nearest) == k else radius
                part = [i for i in order[a : a + step].tolist() if bound[i] <= limit]
                if continuous:
                    found = [frechet.bisect(curve, _curve(points[i]), TOLERANCE) if frechet.decide(curve, _curve(points[i]), limit) else np.inf for i in part]
                else:
                    found = wavefront.coupled([points[i] for i in part], [query] * len(part), limit=limit).tolist()
                for i, d in zip(part, found):
                    if d <= radius:
                        heapq.heappush(nearest, (-d, -tids[i]))
                        if k and len(nearest) > k:
                            heapq.heappop(nearest)
            if not k and nearest:
                yield from _sent(nearest, kind)
                nearest = []
        if nearest:
            yield from _sent(nearest, kind)

    return rows.select("tid", "bound", "pts").mapInArrow(run, f"tid {form}, distance double")


def _sent(nearest, kind):
    yield pa.RecordBatch.from_arrays([pa.array([-t for _, t in nearest], kind), pa.array([-d for d, _ in nearest], pa.float64())], ["tid", "distance"])


def nearest(db: DataFrame, tid, k: int, continuous: bool = False) -> DataFrame:
    """(tid, distance) of the k trajectories nearest to one of the database, (tid, pts) with whole-number ids, itself left out;
    ties go to the smaller id. Trajectories without points take no part."""
    rows, query = _bounded(db, tid)
    first = rows.orderBy("bound", "tid").limit(k)
    seen = [r.distance for r in _measured(first, query, np.inf, None, continuous).collect()]  # k rows
    radius = max(seen) if len(seen) == k else np.inf
    found = _measured(rows.where(F.col("bound") <= F.lit(float(radius))), query, radius, k, continuous)
    return found.orderBy("distance", "tid").limit(k)


def within(db: DataFrame, tid, radius: float, continuous: bool = False) -> DataFrame:
    """(tid, distance) of all trajectories within a radius of one of the database, itself left out."""
    rows, query = _bounded(db, tid)
    return _measured(rows.where(F.col("bound") <= F.lit(float(radius))), query, radius, None, continuous)
