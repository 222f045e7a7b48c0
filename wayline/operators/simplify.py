"""Simplification of trajectories. Each trajectory is worked on by itself, in the task that holds it."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.metrics import PLANAR, Metric, distance_to_segment


def split_weights(p: np.ndarray, eps: float, distance=distance_to_segment) -> tuple[np.ndarray, np.ndarray]:
    """Which points Douglas and Peucker's method keeps, and how far each was from its chord when it was kept (0: never, or an end)."""
    keep, weight = np.zeros(len(p), bool), np.zeros(len(p))
    if len(p):
        keep[[0, -1]] = True
    open_ = [(0, len(p) - 1)]
    while open_:
        lo, hi = open_.pop()
        if hi - lo < 2:
            continue
        d = distance(p[lo + 1 : hi], p[lo], p[hi])
        k = int(d.argmax())
        if d[k] > eps:
            at = lo + 1 + k
            keep[at], weight[at] = True, d[k]
            open_ += [(lo, at), (at, hi)]
    return keep, weight


#: Ends of a window that are tried together.
ENDS = 16


def window_vertices(p: np.ndarray, eps: float) -> np.ndarray:
    """Which points an opening window keeps: the window grows until a point inside is too far from its chord; that point starts the next."""
    keep = np.zeros(len(p), bool)
    if len(p):
        keep[[0, -1]] = True
    start, end = 0, 2
    while end < len(p):
        ends = np.arange(end, min(len(p), end + ENDS))
        chord, inner = p[ends] - p[start], p[start + 1 : ends[-1]] - p[start]
        size = (chord * chord).sum(axis=1)
        flat = size < 1e-12
        t = np.where(flat, 0, np.clip(inner @ chord.T / np.where(flat, 1, size), 0, 1))
        off = np.hypot(inner[:, :1] - t * chord[:, 0], inner[:, 1:] - t * chord[:, 1])
        far = (off > eps) & (np.arange(start + 1, ends[-1])[:, None] < ends)
        first = int(far.any(axis=0).argmax())
        if far[:, first].any():
            start += 1 + int(far[:, first].argmax())
            keep[start] = True
            end = start + 2
        else:
            end = int(ends[-1]) + 1
    return keep


def by_trajectory(points: DataFrame, f, columns: str, also: tuple[str, ...] = ()) -> DataFrame:
    """f(x-y array in order) -> dict of columns of that length, for each trajectory of (tid, seq, x, y); rows where `keep` is false go.

    also: columns of numbers that f gets beside x and y, and that stay in the rows.
    """
    kind = points.schema["tid"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        p = np.column_stack([table.column(c).to_numpy() for c in ("x", "y", *also)]).astype(float)
        made = f(p)
        keep = made.pop("keep", np.ones(len(p), bool))
        out = table.select(["tid", "seq", "x", "y", *also])
        for name, values in made.items():
            out = out.append_column(name, pa.array(values))
        return out.filter(pa.array(keep))

    rows = points.select("tid", points["seq"].cast("long"), points["x"].cast("double"), points["y"].cast("double"), *(points[c].cast("double") for c in also))
    kept = "".join(f", {c} double" for c in also)
    return rows.groupBy("tid").applyInArrow(run, f"tid {kind}, seq long, x double, y double{kept}{columns}")


def douglas_peucker(points: DataFrame, eps: float, metric: Metric = PLANAR) -> DataFrame:
    """(tid, seq, x, y, weight) of the points kept; ends weigh 0."""

    def kept(p):
        keep, weight = split_weights(p, eps, metric.in_task)
        return {"keep": keep, "weight": weight}

    return by_trajectory(points, kept, ", weight double")


def douglas_peucker_weights(points: DataFrame, eps: float, metric: Metric = PLANAR) -> DataFrame:
    """(tid, seq, x, y, weight) of all points; 0 where a point is not kept or an end."""
    return by_trajectory(points, lambda p: {"weight": split_weights(p, eps, metric.in_task)[1]}, ", weight double")


def opening_window(points: DataFrame, eps: float) -> DataFrame:
    """(tid, seq, x, y) of the points kept; trajectories of fewer than three points stay."""
    return by_trajectory(points, lambda p: {"keep": window_vertices(p, eps)}, "")


def surprising(p: np.ndarray, slack: float, turn: float) -> np.ndarray:
    """Which rows (x, y, milliseconds) speed and heading do not foretell; the first two are always among them.

    A step is as foretold if its speed is within `slack`, a share, of a foretelling speed and its heading within `turn` degrees of
    that heading, the short way round. Both the step before and the last two rows kept foretell; both must hold. A step
    that takes no time has no speed; one without length heads along x.
    """

    def speed_and_heading(a, b):
        (dx, dy), seconds = p[b, :2] - p[a, :2], (p[b, 2] - p[a, 2]) / 1000
        return (np.hypot(dx, dy) / seconds if seconds else 0.0), np.degrees(np.arctan2(dy, dx))

    keep = np.ones(len(p), bool)
    before, last = 0, 1
    for i in range(2, len(p)):
        speed, heading = speed_and_heading(i - 1, i)
        told = (speed_and_heading(i - 2, i - 1), speed_and_heading(before, last))
        keep[i] = not all(v * (1 - slack) <= speed <= v * (1 + slack) and abs((heading - h + 180) % 360 - 180) <= turn for v, h in told)
        if keep[i]:
            before, last = last, i
    return keep


def threshold_sampling(points: DataFrame, speed_slack: float, turn_slack: float) -> DataFrame:
    """(tid, seq, x, y, t) of the points of (tid, seq, x, y, t), t in milliseconds, that speed and heading do not foretell: see `surprising`."""
    return by_trajectory(points, lambda p: {"keep": surprising(p, speed_slack, turn_slack)}, "", also=("t",))
