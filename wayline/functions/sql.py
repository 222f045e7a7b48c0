"""Functions for SQL: each is an expression that Spark inlines, so a statement that uses them is planned as if it were written out."""

from pyspark.sql import SparkSession

_POINT = "STRUCT<x: DOUBLE, y: DOUBLE>"
_PATH = f"ARRAY<{_POINT}>"
_APART = "sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2))"
_NEAREST = "array_min(transform({0}, q -> " + _APART + "))"
_TO_NEAREST = "coalesce(array_max(transform({0}, p -> coalesce(array_min(transform({1}, q -> " + _APART + ")), double('inf')))), double('-inf'))"
_PAIRED = "aggregate(zip_with(u, {0}, (p, q) -> {1}), double(0), (s, d) -> s + d)"

#: name -> (parameters, type, expression). Trajectories are arrays of (x, y).
FUNCTIONS = {
    "point_distance": (f"p {_POINT}, q {_POINT}", "DOUBLE", _APART),
    "point_distance_squared": (f"p {_POINT}, q {_POINT}", "DOUBLE", "power(p.x - q.x, 2) + power(p.y - q.y, 2)"),
    "point_to_vertices": (f"p {_POINT}, t {_PATH}", "DOUBLE", f"coalesce({_NEAREST.format('t')}, double(0))"),
    "closest_pair": (f"u {_PATH}, v {_PATH}", "DOUBLE", f"coalesce(array_min(transform(u, p -> {_NEAREST.format('v')})), double(0))"),
    "sum_of_pairs": (f"u {_PATH}, v {_PATH}", "DOUBLE", f"CASE WHEN size(u) = size(v) THEN {_PAIRED.format('v', _APART)} ELSE double(-1) END"),
    "lockstep": (f"u {_PATH}, v {_PATH}", "DOUBLE", "CASE WHEN size(v) >= size(u) THEN sqrt(" + _PAIRED.format("slice(v, 1, greatest(size(u), 1))", "power(p.x - q.x, 2) + power(p.y - q.y, 2)") + ") END"),
    "discrete_hausdorff": (f"u {_PATH}, v {_PATH}", "DOUBLE", f"greatest({_TO_NEAREST.format('u', 'v')}, {_TO_NEAREST.format('v', 'u')})"),
    "trajectory_length": (f"t {_PATH}", "DOUBLE", f"aggregate(zip_with(slice(t, 1, greatest(size(t) - 1, 0)), slice(t, 2, greatest(size(t) - 1, 0)), (p, q) -> {_APART}), double(0), (s, d) -> s + d)"),
    "bits_jaccard": ("a ARRAY<INT>, b ARRAY<INT>", "DOUBLE", "CASE WHEN size(array_union(a, b)) = 0 THEN double(1) ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
    "haversine": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE",
        "DOUBLE",
        "2 * 6371008.8D * asin(least(1D, sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
}


def register(spark: SparkSession, prefix: str = "traj_") -> list[str]:
    """Make FUNCTIONS known to spark.sql for this session, each name after the prefix; returns the names."""
    for name, (parameters, kind, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {expression}")
    return [prefix + name for name in FUNCTIONS]
