"""Simplification by the persistence of turning angles.

Along the curve of turning angles every minimum fills a stretch up to its lower maximum and is paired
with it; stretches that meet at one maximum join there. A pair whose angles differ by more than beta is kept.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simplify import by_trajectory, distance_to_segment


def turning_angles(p: np.ndarray) -> np.ndarray:
    """Signed turn in degrees at every inner point; 0 at ends and where a step has no length."""
    out = np.zeros(len(p))
    if len(p) > 2:
        step = np.diff(p, axis=0)
        length = np.hypot(step[:, 0], step[:, 1])
        ok = (length[:-1] > 0) & (length[1:] > 0)
        unit = step / np.where(length > 0, length, 1)[:, None]
        dot = np.clip((unit[:-1] * unit[1:]).sum(axis=1), -1, 1)
        cross = unit[:-1, 0] * unit[1:, 1] - unit[:-1, 1] * unit[1:, 0]
        out[1:-1] = np.where(ok, np.degrees(np.arccos(dot) * np.where(cross < 0, -1, 1)), 0)
    return out


def extrema(values) -> tuple[list[int], list[int]]:
    """Places of minima and maxima, in turn, plateaus by their last point; none below three values.

    A curve that never turns has its ends, the first as minimum and the last as maximum, besides the end at which it begins.
    """
    v = np.asarray(values, float)
    if len(v) < 3:
        return [], []
    ends = np.append(np.flatnonzero(v[1:] != v[:-1]), len(v) - 1)  # the last point of every level
    rises = v[ends[1:]] > v[ends[:-1]]
    turns = np.flatnonzero(rises[1:] != rises[:-1])
    lows, highs = ends[1:-1][turns[rises[turns + 1]]].tolist(), ends[1:-1][turns[~rises[turns + 1]]].tolist()
    if len(rises):
        (lows if rises[0] else highs).insert(0, 0)
    if not len(turns):
        return [*lows, 0], [*highs, len(v) - 1]
    (highs if rises[-1] else lows).append(len(v) - 1)
    return lows, highs


def pairing(values) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Pairs (minimum, maximum) and the stretches (left, minimum, right).

    Water that rises in every valley runs over its lower brim, the right one of equal brims. A valley
    whose neighbour ran over the same brim before becomes one with it: the later minimum is paired with
    the brim, the earlier one goes on in the wider valley. One whose neighbour never does is paired with its
    brim. Every valley takes a point a turn; of those that run over in one turn the last goes first. In which order valleys fill makes no difference to the pairs, only to
    their order: the place of a valley that joins another is the pair's place.
    """
    lows, highs = extrema(values)
    if not lows:
        return [], []
    v, last = np.asarray(values, float), len(values) - 1
    if set(lows) & set(highs) or len(lows) != len(set(lows)):  # a curve that never turns
        return [(0, last)], [(0, 0, last)]
    walls = [-1] * (lows[0] < highs[0]) + highs + [last + 1] * (lows[-1] > highs[-1])  # no water runs over an open end
    level = lambda wall: v[wall] if 0 <= wall <= last else np.inf
    running: list[tuple] = []  # when and over which brim each valley will run: (turn, -place, brim, left, right, low, a, b)

    def fill(turn, place, left, right, low, a, b):
        brim, before = left if level(left) < level(right) else right, b - a
        if not 0 <= brim <= last:  # nothing holds it: it has all of the curve
            told[place] = None, (0, low, last)
            return
        if brim == left:
            above = np.flatnonzero(v[b + 1 : right] > v[brim])
            a, b = brim, b + int(above[0]) if len(above) else min(right - 1, last)
        else:
            above = np.flatnonzero(v[max(left, -1) + 1 : a] >= v[brim])
            a, b = left + 2 + int(above[-1]) if len(above) else max(left, -1) + 1, brim
        heapq.heappush(running, (turn + b - a - before, -place, brim, left, right, low, a, b))

    told: dict[int, tuple] = {}
    for place, (left, low, right) in enumerate(zip(walls, lows, walls[1:])):
        fill(0, place, left, right, low, low, low)
    waiting: dict[int, tuple] = {}  # brim: the valley that ran over it first
    while running:
        turn, place, brim, left, right, low, a, b = heapq.heappop(running)
        place = -place
        if brim not in waiting:
            waiting[brim] = place, left, right, low, a, b
            told[place] = (low, brim), (a, low, b)
            continue
        other, left2, right2, low2, a2, b2 = waiting[brim]
        later = max(low, low2)
        told[place] = (later, brim), (min(brim, later), later, max(brim, later))
        fill(turn, other, min(left, left2), max(right, right2), min(low, low2), min(a, a2), max(b, b2))
    found = [told[place] for place in sorted(told)]
    return [bar for bar, _ in found if bar], [stretch for _, stretch in found]


def kept_places(values, beta: float) -> list[int]:
    """The ends, and both ends of every pair whose values differ by more than beta."""
    if len(values) < 3:
        return list(range(len(values)))
    inner = {k for low, high in pairing(values)[0] if values[high] - values[low] > beta for k in (low, high)}
    return sorted(inner | {0, len(values) - 1})


def thin_by_distance(places, values, p: np.ndarray, scale: float) -> np.ndarray:
    """Places without points nearer to the next than `scale`: of two such the one that turns less stays. A place may come twice."""
    places = np.asarray(places, np.int64)
    if len(places) < 3:
        return places
    here, after, values = places[1:-1], places[2:], np.asarray(values)
    near = np.hypot(*(p[here] - p[after]).T) < scale
    less = values[here] < values[after]
    chosen = np.where(near & ~less, after, here)
    before = np.append(places[:1], chosen[:-1])
    told = near & less & (before == here)  # it stands there already
    return np.concatenate([places[:1], chosen[~told], places[-1:]])


def multi_resolution(p: np.ndarray, beta: float, levels: int) -> np.ndarray:
    """Places left after `levels` rounds of pruning by beta and thinning at doubling scales; a place may come twice."""
    places = np.arange(len(p))
    for level in range(levels):
        angles = turning_angles(p[places])
        places = places[thin_by_distance(kept_places(angles, beta), angles, p[places], 2.0**level)]
    return places


def segment_distance(p: np.ndarray, beta: float, eps: float, rounds: int) -> np.ndarray:
    """Places left after pruning by beta and `rounds` of dropping points nearer than eps to the chord of their neighbours.

    Of points in a row that are so near every second one stays, beginning with the second. A place may come twice.
    """
    places = np.array(kept_places(turning_angles(p), beta), np.int64)
    for _ in range(rounds):
        if len(places) < 3:
            break
        q = p[places]
        near = np.array([distance_to_segment(q[i : i + 1], q[i - 1], q[i + 1])[0] < eps for i in range(1, len(q) - 1)])
        run = np.arange(len(near)) - np.maximum.accumulate(np.where(near, -1, np.arange(len(near))))
        gone = near & (run % 2 == 1)
        places = np.concatenate([places[:1], places[1:-1][~gone], places[-1:], places[-1:] if gone[-1] else places[:0]])
    return places


def _places(points: DataFrame, choose) -> DataFrame:
    """The chosen points of each trajectory, once each."""

    def run(p):
        keep = np.zeros(len(p), bool)
        keep[choose(p)] = True
        return {"keep": keep}

    return by_trajectory(points, run, "")


def pruned(points: DataFrame, beta: float) -> DataFrame:
    """(tid, seq, x, y) of the points that persistence keeps."""
    return _places(points, lambda p: kept_places(turning_angles(p), beta))


def pruned_multi_resolution(points: DataFrame, beta: float, levels: int = 5) -> DataFrame:
    return _places(points, lambda p: multi_resolution(p, beta, levels))


def pruned_by_segments(points: DataFrame, beta: float, eps: float = 5.0, rounds: int = 5) -> DataFrame:
    return _places(points, lambda p: segment_distance(p, beta, eps, rounds))


def marked_extrema(points: DataFrame) -> DataFrame:
    """(tid, seq, x, y, kind) of the minima and maxima of turning angles."""

    def run(p):
        lows, highs = extrema(turning_angles(p).tolist())
        kind = np.full(len(p), "", object)
        kind[lows], kind[highs] = "min", "max"
        return {"kind": kind.tolist(), "keep": kind != ""}

    return by_trajectory(points, run, ", kind string")


def bars(points: DataFrame) -> DataFrame:
    """(tid, low, high): the pairs of every trajectory, by place."""

    def run(p):
        found = dict(pairing(turning_angles(p).tolist())[0])
        return {"high": [found.get(i, -1) for i in range(len(p))], "keep": np.isin(np.arange(len(p)), list(found))}

    return by_trajectory(points, run, ", high long").select("tid", F.col("seq").alias("low"), "high")


def _by_curve(rows: DataFrame, run, schema: str) -> DataFrame:
    """run(values in order) -> columns, for each curve of (tid, seq, value)."""
    kind = rows.schema["tid"].dataType.simpleString()

    def one(table: pa.Table) -> pa.Table:
        columns = run(table.sort_by("seq").column("value").to_numpy())
        size = len(next(iter(columns.values())))
        return pa.table({"tid": pa.array([table.column("tid")[0].as_py()] * size), **{k: pa.array(np.asarray(c, np.int64)) for k, c in columns.items()}})

    return rows.select("tid", rows["seq"].cast("long"), rows["value"].cast("double")).groupBy("tid").applyInArrow(one, f"tid {kind}, {schema}")


def curve_bars(rows: DataFrame) -> DataFrame:
    """(tid, low, high): the pairs of every curve of (tid, seq, value), whatever its values are."""
    return _by_curve(rows, lambda v: dict(zip(("low", "high"), np.array(pairing(v)[0], np.int64).reshape(-1, 2).T)), "low long, high long")


def curve_stretches(rows: DataFrame) -> DataFrame:
    """(tid, left, low, right): the stretch of every minimum of every curve of (tid, seq, value)."""
    return _by_curve(rows, lambda v: dict(zip(("left", "low", "right"), np.array(pairing(v)[1], np.int64).reshape(-1, 3).T)), "left long, low long, right long")


def multi_resolution_places(points: DataFrame, beta: float, levels: int = 5) -> DataFrame:
    """(tid, n, seq): the places that multi_resolution() leaves, in order and with repeats."""
    kind = points.schema["tid"].dataType.simpleString()

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        kept = multi_resolution(np.column_stack([table.column(c).to_numpy() for c in ("x", "y")]), beta, levels)
        return pa.table({"tid": pa.array([table.column("tid")[0].as_py()] * len(kept)), "n": pa.array(np.arange(len(kept))), "seq": table.column("seq").take(pa.array(kept))})

    rows = points.select("tid", *(points[c].cast(t) for c, t in (("seq", "long"), ("x", "double"), ("y", "double"))))
    return rows.groupBy("tid").applyInArrow(one, f"tid {kind}, n long, seq long")
