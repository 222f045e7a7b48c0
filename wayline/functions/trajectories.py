"""Distances between packed trajectories: arrays of (x, y) structs in order. Each takes the metric of its points, planar unless said."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import PLANAR, Metric

INFINITY = float("inf")


def nearest_vertex(p: Column, t: Column, metric: Metric = PLANAR) -> Column:
    """Smallest distance of a point to the vertices of t; null where t is empty."""
    return F.array_min(F.transform(t, lambda q: metric.points(p, q)))


def nearest_or_infinite(p: Column, t: Column, metric: Metric = PLANAR) -> Column:
    """The same, infinite where t is empty."""
    return F.coalesce(nearest_vertex(p, t, metric), F.lit(INFINITY))


def point_to_vertices(p: Column, t: Column, metric: Metric = PLANAR) -> Column:
    """The same, 0 where t is empty."""
    return F.coalesce(nearest_vertex(p, t, metric), F.lit(0.0))


def point_to_trajectory(p: Column, t: Column, metric: Metric = PLANAR) -> Column:
    """Smallest distance of a point to the segments of t; 0 where t has fewer than two points."""
    pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    d = F.transform(pairs, lambda s: metric.segment(s["a"], s["b"], p))
    return F.coalesce(F.array_min(d), F.lit(0.0))


def closest_pair(u: Column, v: Column, metric: Metric = PLANAR) -> Column:
    """Smallest distance between vertices; 0 where one has none."""
    return F.coalesce(F.array_min(F.transform(u, lambda p: nearest_vertex(p, v, metric))), F.lit(0.0))


def sum_of_pairs(u: Column, v: Column, metric: Metric = PLANAR) -> Column:
    """Sum of the distances of vertices of equal place; -1 where the lengths differ."""
    total = F.aggregate(F.zip_with(u, v, metric.points), F.lit(0.0), lambda s, d: s + d)
    return F.when(F.size(u) == F.size(v), total).otherwise(-1.0)


def discrete_hausdorff(u: Column, v: Column, metric: Metric = PLANAR) -> Column:
    """The largest distance of a vertex of one to the nearest of the other; infinite where only one is empty, -infinite where both are."""

    def directed(a, b):
        return F.coalesce(F.array_max(F.transform(a, lambda p: nearest_or_infinite(p, b, metric))), F.lit(-INFINITY))

    return F.greatest(directed(u, v), directed(v, u))


def lockstep(t: Column, q: Column, metric: Metric = PLANAR) -> Column:
    """Root of the summed squared distances of vertices of equal place, over the length of t; null where q is shorter."""
    pairs = F.zip_with(t, F.slice(q, 1, F.greatest(F.size(t), F.lit(1))), lambda a, b: F.pow(metric.points(a, b), F.lit(2.0)))
    return F.when(F.size(q) >= F.size(t), F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)))


def _last(a: Column) -> Column:
    return F.element_at(a, -1)


def discrete_frechet(u: Column, v: Column, metric: Metric = PLANAR) -> Column:
    """Smallest leash over all couplings of the vertices, row by row; 0 where u is empty, null where only v is."""
    empty = F.array().cast("array<double>")

    def first_row(p):
        return F.aggregate(v, empty, lambda row, q: F.concat(row, F.array(F.greatest(F.when(F.size(row) == 0, 0.0).otherwise(_last(row)), metric.points(p, q)))))

    def next_row(above, p):
        steps = F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda j: F.struct(j.alias("j"), metric.points(p, F.get(v, j)).alias("d")))

        def grow(row, s):
            j = s["j"]
            best = F.when(j == 0, F.get(above, j)).otherwise(F.least(F.get(above, j), F.get(above, j - 1), _last(row)))
            return F.concat(row, F.array(F.greatest(best, s["d"])))

        return F.aggregate(steps, empty, grow)

    rows = F.aggregate(u, empty, lambda above, p: F.when(F.size(above) == 0, first_row(p)).otherwise(next_row(above, p)))
    return F.when(F.size(u) == 0, 0.0).when(F.size(v) > 0, _last(rows))


def dtw_banded(u: Column, v: Column, band: int, metric: Metric = PLANAR) -> Column:
    """Dynamic time warping over the absolute distance, with steps within `band` of the diagonal (at least the difference in length)."""
    empty = F.array().cast("array<double>")
    n, m = F.size(u), F.size(v)
    width = F.greatest(F.lit(band), F.abs(n - m))
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.get(u, i).alias("p")))

    def next_row(above, r):
        i, p = r["i"], r["p"]
        steps = F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.struct(j.alias("j"), F.when(F.abs(i - j) <= width, metric.points(p, F.get(v, j))).otherwise(INFINITY).alias("d")))

        def grow(row, s):
            j = s["j"]
            up = F.when(i == 0, INFINITY).otherwise(F.get(above, j))
            left = F.when(j == 0, INFINITY).otherwise(_last(row))
            corner = F.when((i == 0) & (j == 0), 0.0).when((i == 0) | (j == 0), INFINITY).otherwise(F.get(above, j - 1))
            return F.concat(row, F.array(F.least(up, left, corner) + s["d"]))

        return F.aggregate(steps, empty, grow)

    return F.when((n > 0) & (m > 0), _last(F.aggregate(rows, empty, next_row)))


#: The distances that a specification may name.
BY_NAME = {
    "discrete_frechet": discrete_frechet,
    "closest_pair": closest_pair,
    "sum_of_pairs": sum_of_pairs,
    "dtw": lockstep,
    "discrete_hausdorff": discrete_hausdorff,
}
