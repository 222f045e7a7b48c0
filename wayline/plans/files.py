"""Queries that go by way of the text formats: tables written as files and read again."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import files
from ..storage import shared_dir
from . import tables as t
from .registry import query, r6


def _place(spark, kind):
    return f"{shared_dir(spark)}/wayline-{kind}-{uuid.uuid4().hex}"


@query(f"WITH {t.EVENTS} SELECT dense_rank() OVER (ORDER BY tid) - 1 AS tid, seq, round(x, 6) AS x, round(y, 6) AS y, tid AS id FROM p")
def xyi_read(spark, sf_dir):
    """Trajectories as `x y id` lines, read by splits; numbered where the id changes."""
    path = _place(spark, "xyi")
    files.write_xyi(t.events(spark, sf_dir), path)
    return files.read_xyi(spark, path).select("tid", "seq", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "id")


@query(f"""WITH {t.EVENTS}, k AS (SELECT tid, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY tid ORDER BY seq))
  SELECT dense_rank() OVER (ORDER BY tid) - 1 AS tid, seq, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, tid AS id FROM k WHERE x2 IS NOT NULL""")
def segments_read(spark, sf_dir):
    """Steps of trajectories as `x y x2 y2 id` lines, read by splits."""
    w = Window.partitionBy("tid").orderBy("seq")
    rows = t.events(spark, sf_dir).select("tid", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    path = _place(spark, "segments")
    files.write_segments(rows.where("x2 IS NOT NULL"), path)
    return files.read_segments(spark, path).select("tid", "seq", *(r6(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")), "id")


@query(f"WITH {t.EVENTS} SELECT dense_rank() OVER (ORDER BY 'trajectory=' || tid) - 1 AS tid, seq, round(x, 6) AS x, round(y, 6) AS y FROM p")
def directory_read(spark, sf_dir):
    """A file for each trajectory, numbered by their names."""
    path = _place(spark, "folder")
    files.write_directory(t.events(spark, sf_dir), path, "x", "y")
    return files.read_directory(spark, f"{path}/*").select("tid", "seq", r6(F.get("values", 0)).alias("x"), r6(F.get("values", 1)).alias("y"))
