"""Resampling in time, and affine and projective maps of point tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def projective(matrix):
    """The map of a 3x3 matrix on homogeneous coordinates, as a transform of point tables."""
    if len(matrix) != 3 or any(len(row) != 3 for row in matrix):
        raise ValueError("a projective map takes three rows of three numbers")

    def run(points: DataFrame) -> DataFrame:
        a, b, w = (sum((F.lit(float(m)) * v for m, v in zip(row, (F.col("x"), F.col("y"), F.lit(1.0)))), F.lit(0.0)) for row in matrix)
        return points.withColumns({"x": a / w, "y": b / w})

    return run


def affine(*p):
    """x' = p1 x + p2 y + p3, y' = p4 x + p5 y + p6."""
    if len(p) != 6:
        raise ValueError("an affine map takes six numbers")
    p = [float(v) for v in p]
    return lambda points: points.withColumns({"x": p[0] * F.col("x") + p[1] * F.col("y") + p[2], "y": p[3] * F.col("x") + p[4] * F.col("y") + p[5]})


def translate(s, t):
    return affine(1, 0, s, 0, 1, t)


def scale(a, b):
    return affine(a, 0, 0, 0, b, 0)


def skew(a, b):
    return affine(1, a, 0, b, 1, 0)


def interpolate(points: DataFrame, n: int) -> DataFrame:
    """(tid, i, t, x, y): n points at equal distances of t, by straight lines between neighbours; ends are the first and last point.

    Every step of a trajectory makes the ticks that fall into it, so nothing is joined. One tick is the first point.
    """
    if n < 1:
        raise ValueError("at least one point")
    w = Window.partitionBy("tid").orderBy("t", "seq")
    every = Window.partitionBy("tid")
    rows = points.withColumns({"t0": F.lag("t").over(w), "x0": F.lag("x").over(w), "y0": F.lag("y").over(w), "a": F.min("t").over(every), "b": F.max("t").over(every)})
    gap = (F.col("b") - F.col("a")) / max(1, n - 1)
    tick = lambda i: F.when(i == n - 1, F.col("b")).otherwise(F.col("a") + gap * i) if n > 1 else F.col("a")
    first = F.col("t0").isNull()
    lo = F.when(gap > 0, F.greatest(F.floor((F.coalesce("t0", "t") - F.col("a")) / gap).cast("int") - 1, F.lit(0))).otherwise(0)
    hi = F.when(gap > 0, F.least(F.ceil((F.col("t") - F.col("a")) / gap).cast("int") + 1, F.lit(n - 1))).otherwise(n - 1)
    inside = lambda i: F.when(first, tick(i) == F.col("t")).otherwise((tick(i) > F.col("t0")) & (tick(i) <= F.col("t")))
    ticks = rows.withColumn("i", F.explode(F.filter(F.sequence(lo, hi), inside)))
    at = tick(F.col("i"))
    part = F.when(first | (F.col("t") == F.col("t0")), 1.0).otherwise((at - F.col("t0")) / (F.col("t") - F.col("t0")))
    value = lambda c: F.when(first | (part == 1.0), F.col(c)).otherwise(F.col(f"{c}0") + (F.col(c) - F.col(f"{c}0")) * part)
    return ticks.select("tid", "i", at.alias("t"), value("x").alias("x"), value("y").alias("y"))


def aggregate_frames(points: DataFrame, n: int, columns=("x", "y")) -> DataFrame:
    """(tid, i, columns): piecewise aggregate approximation; point k of m weighs in frame i by how much [k, k+1) overlaps [i m/n, (i+1) m/n)."""
    m = F.count("*").over(Window.partitionBy("tid")).cast("double")
    rows = points.withColumn("m", m)
    k = F.col("seq").cast("double")
    frames = F.sequence(F.floor(k * n / F.col("m")).cast("int"), F.least(F.ceil((k + 1) * n / F.col("m")).cast("int") - 1, F.lit(n - 1)))
    cut = rows.withColumn("i", F.explode(frames))
    i = F.col("i").cast("double")
    weight = F.least(k + 1, (i + 1) * F.col("m") / n) - F.greatest(k, i * F.col("m") / n)
    cut = cut.withColumn("w", F.greatest(weight, F.lit(0.0))).where("w > 0")
    return cut.groupBy("tid", "i").agg(*((F.sum(F.col("w") * F.col(c)) / (F.first("m") / n)).alias(c) for c in columns))


def rescale(points: DataFrame, n: int) -> DataFrame:
    """Each trajectory with n points: frames where it has more, straight lines where it has fewer, untouched where it has n. Without t the place counts."""
    timed = points if "t" in points.columns else points.withColumn("t", F.col("seq").cast("double") + 1)
    sized = timed.withColumn("_n", F.count("*").over(Window.partitionBy("tid")))
    more = aggregate_frames(sized.where(F.col("_n") > n).drop("_n"), n, ("t", "x", "y"))
    fewer = interpolate(sized.where(F.col("_n") < n).drop("_n"), n)
    same = sized.where(F.col("_n") == n).select("tid", F.col("seq").cast("int").alias("i"), "t", "x", "y")
    columns = ["tid", "i", "t", "x", "y"]
    return more.select(columns).union(fewer.select(columns)).union(same)


def scaled(rows: DataFrame, column: str, to: str, by_range: bool = True) -> DataFrame:
    """The column as a share of its range (or of its largest value) over the whole table, within [0, 1]."""
    ends = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    share = (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") if by_range else F.col("_hi"))
    return rows.crossJoin(F.broadcast(ends)).withColumn(to, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi")
