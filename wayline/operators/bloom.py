"""Bloom filters of trajectories' cells, as sorted arrays of set bits: sizes, estimates and filters before exact search.

A filter of m bits and d hashes is the set of positions hash(i, cell) for i < d. Two hashes are
offered: MurmurHash3 (128 bits for 32-bit machines, as published), and MD5, which SQL engines share.
Filters of one index must use one hash.
"""

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import let

_M = 0xFFFFFFFF
#: The constants of MurmurHash3 x86_128.
_C = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)
_ADD = (0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17)
_TURN_K, _TURN_H = (15, 16, 17, 18), (19, 17, 15, 13)


def _rotl(x, r):
    return (x << r | x >> (32 - r)) & _M


def murmur128(data: bytes, seed: int) -> tuple[int, int, int, int]:
    """MurmurHash3 x86_128 as four 32-bit numbers."""
    h = [seed & _M] * 4
    whole = len(data) // 16 * 16

    def word(i, k):
        return _rotl(k * _C[i] & _M, _TURN_K[i]) * _C[(i + 1) % 4] & _M

    for at in range(0, whole, 16):
        for i in range(4):
            k = int.from_bytes(data[at + 4 * i : at + 4 * i + 4], "little")
            h[i] ^= word(i, k)
            h[i] = (_rotl(h[i], _TURN_H[i]) + h[(i + 1) % 4]) * 5 + _ADD[i] & _M
    for i in range(4):
        rest = data[whole + 4 * i : whole + 4 * i + 4]
        if rest:
            h[i] ^= word(i, int.from_bytes(rest, "little"))

    def gather():
        h[0] = (h[0] + h[1] + h[2] + h[3]) & _M
        for i in (1, 2, 3):
            h[i] = (h[i] + h[0]) & _M

    h = [x ^ len(data) for x in h]
    gather()
    for i, x in enumerate(h):
        x = (x ^ x >> 16) * 0x85EBCA6B & _M
        x = (x ^ x >> 13) * 0xC2B2AE35 & _M
        h[i] = x ^ x >> 16
    gather()
    return tuple(h)


def murmur32(data: bytes, seed: int) -> int:
    """MurmurHash3 x86_32."""
    h, whole = seed & _M, len(data) // 4 * 4
    words = [int.from_bytes(data[at : at + 4], "little") for at in range(0, len(data), 4)]
    for at, k in enumerate(words):
        h ^= _rotl(k * 0xCC9E2D51 & _M, 15) * 0x1B873593 & _M
        if 4 * at < whole:
            h = _rotl(h, 13) * 5 + 0xE6546B64 & _M
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & _M
    h = (h ^ h >> 13) * 0xC2B2AE35 & _M
    return h ^ h >> 16


#: The constants of MurmurHash3 x64_128.
_C64, _ADD64 = (0x87C37B91114253D5, 0x4CF5AD432745937F), (0x52DCE729, 0x38495AB5)
_M64 = 0xFFFFFFFFFFFFFFFF


def murmur128_of_64(data: bytes, seed: int) -> tuple[int, int]:
    """MurmurHash3 x64_128 as two 64-bit numbers."""

    def turned(x, r):
        return (x << r | x >> (64 - r)) & _M64

    def lane(i, k):
        return turned(k * _C64[i] & _M64, (31, 33)[i]) * _C64[1 - i] & _M64

    def spread(x):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * factor & _M64
        return x ^ x >> 33

    h, whole = [seed, seed], len(data) // 16 * 16
    for at in range(0, len(data), 16):
        pair = [int.from_bytes(data[at + 8 * i : at + 8 * i + 8], "little") for i in (0, 1)]
        if at == whole:
            h = [x ^ lane(i, k) for i, (x, k) in enumerate(zip(h, pair))]
            break
        for i, k in enumerate(pair):
            h[i] = ((turned(h[i] ^ lane(i, k), (27, 31)[i]) + h[1 - i]) * 5 + _ADD64[i]) & _M64
    a, b = (x ^ len(data) for x in h)
    a = a + b & _M64
    a, b = spread(a), spread(a + b & _M64)
    a = a + b & _M64
    return a, a + b & _M64


def seeded_positions(cell: Column, m: int, d: int) -> Column:
    """Positions by MurmurHash3 of the cell with the hash's number as its seed: other positions than `murmur_positions`."""

    @F.pandas_udf("array<int>")
    def positions(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: None if c is None else [murmur128(c.encode(), i)[0] % m for i in range(d)])

    return positions(cell)


def murmur_positions(cell: Column, m: int, d: int) -> Column:
    """Positions by MurmurHash3 of the hash's number and the cell, seed 42. Hash distinct cells only: this runs in Python."""

    @F.pandas_udf("array<int>")
    def positions(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: None if c is None else [murmur128(f"{i}{c}".encode(), 42)[0] % m for i in range(d)])

    return positions(cell)


def md5_positions(cell: Column, m: int, d: int) -> Column:
    """Positions by the first 32 bits of the MD5 of the hash's number and the cell."""
    one = lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(str(i)), cell)), 1, 8), 16, 10).cast("long") % m
    return F.array(*(one(i).cast("int") for i in range(d)))


def rational_positions(cell: Column, m: int, d: float, share: Column, hashes=md5_positions) -> Column:
    """Positions with a number of hashes that is no whole number: an element takes one more where its own `share` of 1 is small enough."""
    whole = int(d)
    every = hashes(cell, m, whole + 1)
    return F.when(share <= d - whole, every).otherwise(F.slice(every, 1, whole))


def share_of(cell: Column) -> Column:
    """A number in [0, 1] that follows from the cell."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit("share"), cell)), 1, 8), 16, 10).cast("long") % 10000) / 9999.0


def filters(sets: DataFrame, m: int = 1024, d: int = 5, hashes=md5_positions, positions=None) -> DataFrame:
    """(tid, n, bits): the filter of every trajectory of (tid, cell); each distinct cell is hashed once."""
    hashed = sets.select("cell").distinct().withColumn("at", positions(F.col("cell")) if positions else hashes(F.col("cell"), m, d))
    spread = sets.join(hashed, "cell").select("tid", "cell", F.explode("at").alias("at"))
    return spread.groupBy("tid").agg(F.count_distinct("cell").alias("n"), F.array_sort(F.collect_set("at")).alias("bits"))


def zero_share(bits: Column, m: int) -> Column:
    return (m - F.size(bits)) / F.lit(float(m))


def size_estimate(bits: Column, m: int, d: float) -> Column:
    return -F.log(zero_share(bits, m)) * m / d


def union_estimate(a: Column, b: Column, m: int, d: float) -> Column:
    return -F.log(1 - F.size(F.array_union(a, b)) / F.lit(float(m))) * m / d


def intersection_estimate(a: Column, b: Column, m: int, d: float) -> Column:
    return size_estimate(a, m, d) + size_estimate(b, m, d) - union_estimate(a, b, m, d)


def jaccard_estimate(a: Column, b: Column, m: int, d: float) -> Column:
    """1 where the union is estimated empty."""
    union = union_estimate(a, b, m, d)
    return F.when(union > 0, 1 - intersection_estimate(a, b, m, d) / union).otherwise(1.0)


def empty(bits: Column) -> Column:
    return F.size(bits) == 0


def summary(bits: Column, m: int) -> Column:
    """The size of a filter and how many of its bits are set."""
    return F.struct(F.lit(m).alias("size"), F.size(bits).alias("ones"))


def resized(filters_: DataFrame) -> DataFrame:
    """(tid, n, bits) after a change of size: nothing is kept, as positions depend on it."""
    return filters_.select("tid", F.lit(0).cast("long").alias("n"), F.array().cast("array<int>").alias("bits"))


def folded(bits: Column, m: int, to: int) -> Column:
    """A filter made smaller without hashing again: positions modulo a size that divides the old one. It holds what it held."""
    if m % to:
        raise ValueError("the new size must divide the old one")
    return F.array_sort(F.array_distinct(F.transform(bits, lambda b: b % to)))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def contradictions(query: Column, bits: Column) -> Column:
    """Share of the query's bits that are not set."""
    return F.size(F.array_except(query, bits)) / F.size(query)


def contains(bits: Column, at: Column) -> Column:
    return F.forall(at, lambda p: F.array_contains(bits, p))


def lower_bound(hits: Column, misses: Column, n: Column) -> Column:
    """A lower bound of the Jaccard distance: the query's cells that the filter holds, over the filter's elements and the cells it does not hold."""
    return 1 - hits / (n + misses)


def histogram(bits: Column, m: int, slices: int) -> Column:
    """Share of set bits in each slice of the filter."""
    if m % slices:
        raise ValueError("the number of slices must divide the size of the filter")
    width = m // slices
    return F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.size(F.filter(bits, lambda b: F.floor(b / width) == i)) / F.lit(float(width)))


def may_hold(query: Column, index: Column) -> Column:
    """Whether a filter of histogram `index` can hold all of a query of histogram `query`."""
    return F.forall(F.zip_with(query, index, lambda q, x: q <= x), lambda ok: ok)


def counting(cells: DataFrame, m: int, d: int, hashes=md5_positions) -> DataFrame:
    """(tid, at, count): a counting filter of (tid, cell) rows, repeats counted."""
    times = cells.groupBy("tid", "cell").count()
    hashed = times.select("cell").distinct().withColumn("at", hashes(F.col("cell"), m, d))
    return times.join(hashed, "cell").select("tid", "count", F.explode("at").alias("at")).groupBy("tid", "at").agg(F.sum("count").alias("count"))


def counted(filters_: DataFrame, asked: DataFrame, m: int, d: int, hashes=md5_positions) -> DataFrame:
    """(tid, cell, count): how often each asked (tid, cell) was added, at most: the smallest of its counters."""
    spread = asked.withColumn("at", F.explode(hashes(F.col("cell"), m, d)))
    found = spread.join(filters_, ["tid", "at"], "left").groupBy("tid", "cell").agg(F.min(F.coalesce("count", F.lit(0))).alias("count"))
    return found


def removed(filters_: DataFrame, cells: DataFrame, m: int, d: int, hashes=md5_positions) -> DataFrame:
    """The counting filter with each of (tid, cell) taken out once; counters never fall below zero."""
    less = counting(cells, m, d, hashes).withColumnRenamed("count", "less")
    return filters_.join(less, ["tid", "at"], "left").select("tid", "at", F.greatest(F.col("count") - F.coalesce("less", F.lit(0)), F.lit(0)).alias("count"))


def decaying(cells: DataFrame, m: int, d: int, life: int, hashes=md5_positions) -> DataFrame:
    """(tid, at, expires): a filter of (tid, cell, time) rows in which every bit lasts `life` units from its last setting."""
    hashed = cells.select("cell").distinct().withColumn("at", hashes(F.col("cell"), m, d))
    spread = cells.join(hashed, "cell").select("tid", F.explode("at").alias("at"), "time")
    return spread.groupBy("tid", "at").agg((F.max("time") + life).alias("expires"))


def alive(decaying_: DataFrame, now) -> DataFrame:
    """(tid, bits) still set at a time."""
    return decaying_.where(F.col("expires") > now).groupBy("tid").agg(F.array_sort(F.collect_set("at")).alias("bits"))


def _chunks(bits: Column, m: int, n: int) -> Column:
    """The filter in n chunks, the bits of each as one number."""
    first = lambda c: F.ceil(c * F.lit(m) / F.lit(n)).cast("int")
    own = lambda c: F.filter(bits, lambda b: F.floor(b * F.lit(n) / F.lit(m)) == c)
    bit = lambda b, c: F.call_function("shiftleft", F.lit(1).cast("long"), (b - first(c)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.aggregate(own(c), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(bit(b, c))))


def close_pairs(filters_: DataFrame, limit: int, m: int = 1024) -> DataFrame:
    """(a, b) with a < b whose filters of m bits differ in fewer than `limit` bits.

    Cut in `limit` chunks, two such filters agree on one of them at least: they meet by chunk and its
    bits, are compared if their numbers of bits are near enough, and only where they meet first.
    Filters that share a chunk's bits with very many others, as an empty chunk may be, meet them all.
    """
    n = max(limit, -(-m // 62))
    rows = filters_.select("tid", F.size("bits").alias("ones"), _chunks(F.col("bits"), m, n).alias("chunks"))
    met = rows.select("tid", "ones", "chunks", F.posexplode("chunks").alias("at", "value"))
    left = met.select("at", "value", F.col("tid").alias("a"), F.col("ones").alias("p"), F.col("chunks").alias("x"))
    right = met.select("at", "value", F.col("tid").alias("b"), F.col("ones").alias("q"), F.col("chunks").alias("y"))
    apart = F.zip_with("x", "y", lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    near = left.join(right, ["at", "value"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("p") - F.col("q")) < limit))
    told = near.select("a", "b", "at", apart.alias("apart")).where(F.array_position("apart", 0) == F.col("at") + 1)
    return told.where(F.aggregate("apart", F.lit(0), lambda s, v: s + v) < limit).select("a", "b")


#: Filters that are decided one after another in a round, at most, and the bytes of them and of a batch in tasks.
ROUND, ROUND_BYTES = 8192, 4 << 20


def _words(filters_: DataFrame, m: int) -> DataFrame:
    """(tid, words): the bits of each filter packed."""
    wide = -(-m // 64) * 64

    def pack(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, rows := max(1, ROUND_BYTES // wide)):
                batch = whole.slice(at, rows)
                bits = batch.column("bits")
                held = np.zeros((batch.num_rows, wide), bool)
                held[np.repeat(np.arange(batch.num_rows), bits.value_lengths().fill_null(0)), bits.flatten()] = True
                yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array([w.tobytes() for w in np.packbits(held, axis=1)], pa.binary())], ["tid", "words"])

    return filters_.select("tid", "bits").mapInArrow(pack, f"tid {filters_.schema['tid'].dataType.simpleString()}, words binary")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def leader_classes(filters_: DataFrame, limit: int = 25, m: int = 1024) -> DataFrame:
    """(tid, leader): each filter joins the first leader, by id, that differs in fewer than `limit` bits, or leads itself.

    Decided in rounds: the smallest undecided ids, ROUND at most, one after another, as that order is what the classes
    depend on; then their leaders go to all tasks, and every undecided filter joins the first that is near it. No pairs
    are made: a filter meets the leaders before its own, and is done with there.
    """
    from ..storage import discard, materialise

    if limit <= 0:
        return filters_.select("tid", F.col("tid").alias("leader"))
    kind = filters_.schema["tid"].dataType.simpleString()
    many = max(1, min(ROUND, ROUND_BYTES * 8 // max(1, m)))
    held = materialise(_words(filters_, m), "filters")
    told = [materialise(held.where("tid IS NULL").select("tid", F.col("tid").alias("leader")), "leaders")]
    left = held.where("tid IS NOT NULL")
    while head := left.orderBy("tid").limit(many).collect():
        words = np.frombuffer(b"".join(r.words for r in head), np.uint64).reshape(len(head), -1)
        rest, leads = np.arange(len(head)), []
        while len(rest):
            leads.append(rest[0])
            rest = rest[_apart(words[rest], words[rest[0]]) >= limit]
        fresh = materialise(left.mapInArrow(_following([head[i].tid for i in leads], words[leads], limit), f"tid {kind}, words binary, leader {kind}"), "filters")
        told.append(materialise(fresh.where("leader IS NOT NULL").select("tid", "leader"), "leaders"))
        discard(held)
        held, left = fresh, fresh.where("leader IS NULL").select("tid", "words")
    discard(held)
    return reduce(DataFrame.union, told)


def _following(ids: list, leaders: np.ndarray, limit: int):
    """Batches of (tid, words) with the first of the leaders near each, null where none is."""

    def follow(batches):
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            found, rest, at = np.full(len(words), -1), np.arange(len(words)), 0
            while at < len(leaders) and len(rest):
                part = leaders[at : at + max(1, ROUND_BYTES // (8 * words.shape[1] * len(rest)))]
                near = _apart(words[rest, None], part) < limit
                any_ = near.any(axis=1)
                found[rest[any_]] = at + near[any_].argmax(axis=1)
                rest, at = rest[~any_], at + len(part)
            kind = batch.column("tid").type
            yield batch.append_column("leader", pa.array(ids, kind).take(pa.array(found, mask=found < 0)))

    return follow
