"""Metrics for the distances of trajectories and for simplification, and how to bring one's own.

A metric is three functions: of two points as columns of structs (x, y); of the ends of a segment and a point, likewise; and, for
work inside a task, of an array of points and the ends of a segment. Leave out those that are not used.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geodesic
from . import geometry as g


def _planar_segment(u: Column, v: Column, p: Column) -> Column:
    return g.segment_distance(u["x"], u["y"], v["x"], v["y"], p["x"], p["y"])


def distance_to_segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points to one segment; to its first end where it has no length."""
    d = b - a
    length = float(d @ d)
    if length < 1e-12:
        return np.sqrt(((p - a) ** 2).sum(axis=1))
    t = np.clip((p - a) @ d / length, 0, 1)
    return np.sqrt(((p - a - t[:, None] * d) ** 2).sum(axis=1))


def _no_segment(u, v, p):
    raise ValueError("this metric measures no distance to a segment")


@dataclass(frozen=True)
class Metric:
    points: Callable[[Column, Column], Column]
    segment: Callable[[Column, Column, Column], Column] = _no_segment
    in_task: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = _no_segment


PLANAR = Metric(g.between, _planar_segment, distance_to_segment)
#: Squared planar distances; of segments the square of the distance.
SQUARED = Metric(lambda a, b: g.squared(a["x"], a["y"], b["x"], b["y"]), lambda u, v, p: F.pow(_planar_segment(u, v, p), F.lit(2.0)), lambda p, a, b: distance_to_segment(p, a, b) ** 2)
#: Metres on the WGS84 ellipsoid; x is the latitude, y the longitude. Null between nearly antipodal points.
GEODESIC = Metric(lambda a, b: g.geodesic(a["x"], a["y"], b["x"], b["y"]), in_task=geodesic.points_to_segment)
#: Metres on a sphere, much cheaper; x is the latitude, y the longitude.
GREAT_CIRCLE = Metric(lambda a, b: g.haversine(a["x"], a["y"], b["x"], b["y"]))
