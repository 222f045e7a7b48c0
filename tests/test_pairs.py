"""Distances within groups, measured by blocks, against the expressions pair by pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import compare


def _odd(spark):
    """Trajectories of several lengths, with nulls, empty ones, repeated and missing ids."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        n = (0, 1, 3, 3, 5)[i % 5]
        pts = [(float(x), float(y)) for x, y in rng.normal(size=(n, 2))]
        if i % 17 == 0 and n:
            pts[-1] = None
        if i % 23 == 0 and n:
            pts[0] = (None, 1.0)
        rows.append((i * 7 % 100 if i < 110 else None, None if i % 31 == 30 else pts, None if i % 40 == 39 else i % 3))
    return spark.createDataFrame(rows, "tid long, pts array<struct<x: double, y: double>>, grp int")


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("name", compare.BY_PLACE)
def test_blocks_equal_pairs(spark, monkeypatch, name, kind):
    monkeypatch.setattr(compare, "BLOCK", 7)
    db = _odd(spark).withColumn("tid", F.col("tid").cast(kind))
    a = db.select("grp", F.col("tid").alias("i"), F.col("pts").alias("u"))
    b = db.select("grp", F.col("tid").alias("j"), F.col("pts").alias("v"))
    wanted = a.join(b, "grp").where("i < j").select("grp", "i", "j", compare.distance(name, F.col("u"), F.col("v")).alias("distance"))
    made = compare.within_groups(db, name)
    assert made.schema.simpleString() == wanted.schema.simpleString()
    told = lambda df: sorted((r.grp, r.i, r.j, -2.0 if r.distance is None else round(r.distance, 12)) for r in df.collect())
    assert told(made) == told(wanted)


@pytest.mark.parametrize("name", compare.BY_PLACE)
def test_one_group_is_work_for_many_tasks(spark, monkeypatch, name):
    """No group of Arrow batches holds more than two blocks of one group's trajectories."""
    monkeypatch.setattr(compare, "BLOCK", 16)
    db = spark.range(400).select(F.col("id").alias("tid"), F.lit(1).alias("grp"), F.array(F.struct(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))).alias("pts"))
    made = compare.within_groups(db, name)
    assert made.where("distance = j - i").count() == 400 * 399 // 2
    tasks = made.groupBy(F.spark_partition_id().alias("task")).count()
    assert tasks.count() > 4 and tasks.agg(F.max("count")).first()[0] < 400 * 399 // 4
