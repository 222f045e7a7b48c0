"""A bit-sliced index of filters: for every bit, which trajectories have it set.

Trajectories are numbered without gaps and lie in buckets of 32,768; a slice is one bit's bitmap of one
bucket. The filters that hold a query are the AND of the slices of the query's bits, so a search
reads those slices and no filter. Buckets where a bit has no slice at all are ruled out before any
bitmap is read, by the slices' counts alone.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import let
from ..storage import materialise
from .scan import ranks

#: Bytes of a bitmap.
BYTES = 4096


@dataclass
class SlicedIndex:
    """slices: (bit, bucket, ones, members), in order of bits; numbers: (tid, number)."""

    slices: DataFrame
    numbers: DataFrame


def build(filters: DataFrame) -> SlicedIndex:
    """The index of (tid, bits); a filter without bits is in no slice."""
    numbers = materialise(ranks(filters, "tid", rank="number").withColumn("number", F.col("number") + 1), "numbers")
    rows = filters.join(numbers, "tid").select("number", F.explode("bits").alias("bit"))
    rows = rows.groupBy("bit", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("members"))
    slices = rows.select("bit", "bucket", F.bitmap_count("members").alias("ones"), "members")
    return SlicedIndex(materialise(slices.repartitionByRange("bit", "bucket").sortWithinPartitions("bit", "bucket"), "slices"), numbers)


def _positions(bitmap: Column) -> Column:
    """The places of the bits set in a bitmap, from 0."""
    place = lambda i: F.substring(bitmap, i + 1, F.lit(1))
    filled = F.filter(F.sequence(F.lit(0), F.lit(BYTES - 1)), lambda i: place(i) != F.unhex(F.lit("00")))
    is_set = lambda v, k: F.call_function("shiftright", v, k).bitwiseAND(F.lit(1)) == 1
    each = lambda v, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: is_set(v, k)), lambda k: i * 8 + k)
    return F.flatten(F.transform(filled, lambda i: let(F.conv(F.hex(place(i)), 16, 10).cast("int"), lambda v: each(v, i))))


def _named(found: DataFrame, index: SlicedIndex, *keep: str) -> DataFrame:
    rows = found.select(*keep, "bucket", F.explode(_positions(F.col("members"))).alias("at"))
    rows = rows.select(*keep, ((F.col("bucket") - 1) * (8 * BYTES) + F.col("at") + 1).alias("number"))
    return rows.join(index.numbers, "number").select(*keep, "tid")


def holding(index: SlicedIndex, bits: list[int]) -> DataFrame:
    """(tid): the filters in which all of a query's bits are set. The bits reach the scan of the slices as a filter."""
    asked = index.slices.where(F.col("bit").isin(sorted(set(bits))))
    whole = asked.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") == len(set(bits))).select("bucket")
    found = asked.join(whole, "bucket", "left_semi").groupBy("bucket").agg(F.bitmap_and_agg("members").alias("members"))
    return _named(found, index)


def held(index: SlicedIndex, queries: DataFrame) -> DataFrame:
    """(query, tid) of (query, bits): which filters hold which queries. A query without bits is passed over."""
    asked = queries.select("query", F.explode(F.array_distinct("bits")).alias("bit"))
    many = asked.groupBy("query").agg(F.count("*").alias("n"))
    counted = asked.join(index.slices.select("bit", "bucket"), "bit").groupBy("query", "bucket").agg(F.count("*").alias("found"))
    whole = counted.join(many, "query").where("found = n").select("query", "bucket")
    found = asked.join(whole, "query").join(index.slices.select("bit", "bucket", "members"), ["bit", "bucket"])
    return _named(found.groupBy("query", "bucket").agg(F.bitmap_and_agg("members").alias("members")), index, "query")
