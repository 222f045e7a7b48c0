"""Trajectories made of the driver's tables, and the same as SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir):
    """tid: user; x: place in time, y: value; lon and lat from the event's number."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", (F.row_number().over(order) - 1).cast("long").alias("seq"))
    return rows.select(
        F.col("user_id").alias("tid"), "seq", F.col("seq").cast("double").alias("x"), F.col("value").alias("y"),
        ((F.col("event_id") * 7919 % 36000) / 100.0 - 180).alias("lon"), ((F.col("event_id") * 104729 % 18000) / 100.0 - 90).alias("lat"),
    )


EVENTS = """p AS (
  SELECT user_id AS tid, seq, CAST(seq AS DOUBLE) AS x, value AS y, (event_id * 7919 % 36000) / 100.0 - 180 AS lon, (event_id * 104729 % 18000) / 100.0 - 90 AS lat
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events)
)"""


def vectors(spark, sf_dir):
    """tid: vector, grp: label; 32 points from 64 components."""
    pair = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("embedding", i * 2).cast("double").alias("x"), F.get("embedding", i * 2 + 1).cast("double").alias("y")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tid"), F.col("label").alias("grp"), pair.alias("pts"))


VECTORS = """p AS (
  SELECT vec_id AS tid, label AS grp, i AS seq, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y
  FROM embeddings, (SELECT unnest(range(32)) AS i)
)"""


def supply(spark, sf_dir):
    """tid: supplier; x: place in time, y: quantity. Long trajectories."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tid"), (F.row_number().over(order) - 1).cast("long").alias("seq"), F.col("l_quantity").alias("y"))
    return rows.select("tid", "seq", F.col("seq").cast("double").alias("x"), "y")


SUPPLY = """p AS (
  SELECT l_suppkey AS tid, seq, CAST(seq AS DOUBLE) AS x, l_quantity AS y
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity) - 1 AS seq FROM lineitem)
)"""
