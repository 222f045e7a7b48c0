"""Connected components of a table of links, with the links kept in Spark throughout."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of (src, dst) links; loops and repeats are harmless.

    Alternates two contractions until nothing changes: every node hands its larger neighbours, then
    its smaller ones, to the smallest neighbour. Each step is a group-by whose minimum is combined
    before the shuffle and a join that adaptive execution can split, so a node with very many
    links is never held in one place. Each round is written to the shared folder.
    """
    pairs = links.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).where("hi <> lo").distinct()
    now = materialise(pairs, "links")
    state = _state(now)
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", F.col("m").alias("lo")))
        then = materialise(small.where("hi <> lo").distinct(), "links")
        reached = _state(then)
        discard(now)
        now = then
        if reached == state:
            break
        state = reached
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def _state(pairs: DataFrame) -> tuple:
    """What a round leaves, in a few numbers: at the fixed point every node has one link, to its root, and none changes."""
    row = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))"), F.expr("sum(cast(xxhash64(lo, hi) as decimal(38, 0)))")).first()
    return tuple(row)
