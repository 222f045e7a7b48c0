"""Point tables and packed trajectories: identifiers, separators, packing and selection.

The point form has a row for each point: tid, seq (its place, from 0), x, y and maybe t. In the
separated form trajectories follow each other in one ordered table, a row without x (null or NaN)
between them. Order is always given by a column, never by how rows happen to lie.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import number_runs


def is_separator(x: str = "x") -> Column:
    return F.col(x).isNull() | F.isnan(x)


def trajectory_ids(rows: DataFrame, order: str = "seq", x: str = "x", blocks: int | None = None) -> DataFrame:
    """Separated rows with `tid`: from 1, null on separators; several separators in a row count as one."""
    marked = rows.withColumn("_separates", is_separator(x))
    # a trajectory begins at a point whose predecessor is a separator or missing
    found = number_runs(marked, [order], lambda before: ~F.col("_separates") & F.coalesce(before["_separates"], F.lit(True)), ["_separates"], blocks=blocks)
    return found.withColumn("tid", F.when(~F.col("_separates"), F.col("_run") + 1)).drop("_separates", "_run", "_place")


def remove_separators(rows: DataFrame, x: str = "x") -> DataFrame:
    return rows.where(~is_separator(x))


def add_separators(points: DataFrame) -> DataFrame:
    """(tid, seq, x, y) with a row without coordinates after the last point of every trajectory."""
    last = points.groupBy("tid").agg((F.max("seq") + 1).alias("seq"))
    nothing = F.lit(None).cast("double")
    return points.select("tid", "seq", "x", "y").union(last.select("tid", "seq", nothing, nothing))


def pack(points: DataFrame, *columns: str) -> DataFrame:
    """(tid, pts): one row for each trajectory, its points in order of seq."""
    columns = columns or ("x", "y")
    rows = F.array_sort(F.collect_list(F.struct("seq", *columns)))
    return points.groupBy("tid").agg(F.transform(rows, lambda p: F.struct(*(p[c].alias(c) for c in columns))).alias("pts"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("tid", F.posexplode("pts").alias("seq", "p")).select("tid", F.col("seq").cast("long").alias("seq"), "p.*")


def uniform_select(points: DataFrame, step: int = 15, with_end: bool = True) -> DataFrame:
    """Every `step`-th point of each trajectory, and its last."""
    keep = F.col("seq") % step == 0
    if not with_end:
        return points.where(keep)
    last = F.max("seq").over(Window.partitionBy("tid"))
    return points.withColumn("_last", last).where(keep | (F.col("seq") == F.col("_last"))).drop("_last")


def remove_adjacent(values: Column) -> Column:
    """Of ascending runs of whole numbers only the last; the number before the last goes always, the last stays."""
    n = F.size(values)
    head = F.filter(F.slice(values, 1, F.greatest(n - 2, F.lit(0))), lambda v, i: v + 1 != F.get(values, i + 1))
    return F.when(n < 2, values).otherwise(F.concat(head, F.slice(values, n, 1)))
