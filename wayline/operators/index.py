"""Trajectories as sets of cells: exact and inverted indexes, and search by Jaccard distance."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geohash
from .scan import ranks


def set_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def set_intersect(a: Column, b: Column) -> Column:
    """The members of a that are in b, in a's order and as often as in a."""
    return F.filter(a, lambda x: F.array_contains(b, x))


def cells(points: DataFrame, length: int = 8) -> DataFrame:
    """(tid, seq, cell) of points with lat and lon; points outside the world have none."""
    coded = points.select("tid", "seq", geohash.encode(F.col("lat"), F.col("lon"), length).alias("cell"))
    return coded.where("cell IS NOT NULL")


def cell_sets(points: DataFrame, length: int = 8) -> DataFrame:
    """(tid, cell): the distinct cells of each trajectory, a row for each."""
    return cells(points, length).select("tid", "cell").distinct()


def packed_sets(sets: DataFrame) -> DataFrame:
    return sets.groupBy("tid").agg(F.array_sort(F.collect_set("cell")).alias("cells"))


def inverted(sets: DataFrame) -> DataFrame:
    """(cell, tids): which trajectories enter each cell, in order."""
    return sets.groupBy("cell").agg(F.array_sort(F.collect_set("tid")).alias("tids"))


def plan(sets: DataFrame, query_cells: DataFrame, compat: bool = False) -> DataFrame:
    """(tid, hit): trajectories in the order in which a search should look at them: those that share a cell with the query, then the rest.

    compat: the second part holds all trajectories again, hits too.
    """
    everyone = sets.select("tid").distinct()
    hits = sets.join(query_cells.select("cell").distinct(), "cell", "left_semi").select("tid").distinct()
    rest = everyone if compat else everyone.join(hits, "tid", "left_anti")
    return hits.withColumn("hit", F.lit(True)).union(rest.withColumn("hit", F.lit(False)))


def search_order(sets: DataFrame, query_cells: DataFrame, most: int, compat: bool = False) -> DataFrame:
    """(position, tid, hit): ids below `most` in the order in which a search visits them: hits ascending, then the rest ascending.

    compat: the second part visits all ids below `most` again. Ids without a cell are visited too.
    """
    hits = sets.join(query_cells.select("cell").distinct(), "cell", "left_semi").select(F.col("tid").cast("long").alias("tid")).distinct()
    every = sets.sparkSession.range(most).select(F.col("id").alias("tid"))
    rest = every if compat else every.join(hits, "tid", "left_anti")
    rows = hits.withColumn("rest", F.lit(0)).union(rest.withColumn("rest", F.lit(1)))
    return ranks(rows, "rest", "tid", rank="position").select("position", "tid", (F.col("rest") == 0).alias("hit"))


def jaccard(sets: DataFrame, query_cells: DataFrame) -> DataFrame:
    """(tid, shared, size, distance): exact Jaccard distance of every trajectory's cells to the query's; 1 where both are empty.

    Only cells that the query has are joined; every other trajectory is at distance 1.
    """
    asked = query_cells.select("cell").distinct()
    n = asked.agg(F.count("*").alias("n"))
    shared = sets.join(asked.withColumn("_in", F.lit(1)), "cell", "left").groupBy("tid").agg(F.count("_in").alias("shared"), F.count("*").alias("size"))
    return shared.crossJoin(F.broadcast(n)).select("tid", "shared", "size", (1 - F.col("shared") / (F.col("size") + F.col("n") - F.col("shared"))).alias("distance"))
