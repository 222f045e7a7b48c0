"""Bounded training samples: which rows are taken depends only on a hash of what they hold, not on order or partitioning."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

#: Draws are whole numbers below this.
DRAWS = 1 << 20


def stratified(rows: DataFrame, label: str, by: list[str], quota: int, most_rows: int) -> DataFrame:
    """rows with `key`, about `quota` of each label and, through a smaller quota where labels are many, about `most_rows` in all.

    The labels are counted first; a row then stays if the hash `key` of its columns `by` falls under
    its label's share, so nothing is shuffled but counts. Every label is represented, however rare.
    Repeats of one row have one key: drop them by it before anything is gathered.
    """
    counts = materialise(rows.groupBy(label).agg(F.count("*").alias("_n")), "labels")
    quota = min(quota, max(1, most_rows // max(1, counts.count())))
    key = F.xxhash64(*(F.col(c).cast("string") for c in by), F.lit("sample"))
    drawn = rows.withColumn("key", key).join(counts, label)
    return drawn.where(F.pmod("key", F.lit(DRAWS)) < F.lit(float(quota)) / F.col("_n") * DRAWS).drop("_n")


def bounded(rows: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """Fewer rows, drawn by a hash of the key, where their sizes add up to more than about `most`; every row stays whole."""
    held = rows.agg(F.sum(size)).first()[0] or 0
    if held <= most:
        return rows
    drawn = F.pmod(F.xxhash64(F.col(key), F.lit("bounded")), F.lit(DRAWS))
    return rows.where(drawn < int(most / held * DRAWS))
