"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected on several random subspaces; in each they are put on a grid whose lines stand at
shifted quantiles and ordered along a Hilbert curve. Every ordering is range-partitioned into blocks.
A query reads a window of as many rows on either side of its place in every ordering; the nearest of
all windows merge and are reranked in double precision on the original vectors.

A window has a fixed number of rows: the smallest, in powers of the square root of two from `least`
on, in which `target` of the true neighbours of a bounded sample of other rows stand. These are found by
brute force and their places counted exactly, over all rows. Vectors with structure get by with short windows, whose share of the table falls as
it grows; vectors spread evenly in many dimensions need wide ones, as any index does.

In the orderings vectors travel as one byte a dimension, on a scale of even steps and quantiles; of each window the nearest by these bytes, twice
as many as asked for, go on to the rerank. Quantiles, splitters and scales are fitted on a sample of about
`sample` vectors; every vector is indexed. Of vectors that are equal only as many as an answer could
hold, those of the smallest ids, are kept; equal queries are searched once. Vectors in one cell of
the grid are ordered by a hash of the id, so no block outgrows its size, however dense a cluster is.

Vectors that are null, zero, of another length than the commonest, or that hold null or non-finite
components take no part, as candidates or queries; nor do rows without id. Ties go to the smaller
id. Fewer candidates than asked for are all returned. Only id and vector are read, so further
columns never clash.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise, scratch
from . import text as tx

CURVES = 16
DIMENSIONS = 12
BITS = 3
SAMPLE = 20_000
PROBES = 96
TARGET = 0.96
LEAST = 128
BLOCK_ROWS = 8192
#: Bytes of vectors that a task gathers before it deals them out.
GATHER = 8 << 20


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of grid cells (one column a dimension)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    side = 1 << (bits - 1)
    while side > 1:  # undo the turns of each level, from the coarsest
        below = side - 1
        for i in range(n):
            far = (x[i] & side) != 0
            swap = np.where(far, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(far, below, swap)
            if i:
                x[i] ^= swap
        side >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, side = np.zeros_like(x[0]), 1 << (bits - 1)
    while side > 1:
        turn ^= np.where(x[n - 1] & side, side - 1, 0)
        side >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | (row >> level & 1)
    return key


class Curves:
    """The orderings: projections, shifted quantile grids and the splitters between blocks; and the byte scale of each dimension."""

    def __init__(self, sample: np.ndarray, sample_ids: np.ndarray, blocks: int, curves: int, dimensions: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        dimensions = min(dimensions, width)
        self.bits, self.tie, self.blocks = bits, 62 - bits * dimensions, blocks
        # levels of the bytes: half at even steps, half at quantiles, which tell the members of a dense cluster apart
        low, high = np.quantile(sample, [0.001, 0.999], axis=0)
        even = low + (high - low) * np.linspace(-0.125, 1.125, 128)[:, None]
        self.levels = np.sort(np.concatenate([even, np.quantile(sample, np.linspace(0, 1, 127), axis=0)]), axis=0).T.copy()
        ends = np.concatenate([self.levels[:, :1], self.levels, self.levels[:, -1:]], axis=1)
        self.middles = ((ends[:, 1:] + ends[:, :-1]) / 2).astype(np.float32)
        self.maps, self.lines, self.splitters = [], [], []
        for _ in range(curves):
            basis = np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dimensions]
            at = (np.arange((1 << bits) - 1) + rng.random((dimensions, 1)) * 0.9 + 0.1) / (1 << bits)
            seen = sample @ basis
            self.maps.append(basis)
            self.lines.append([np.quantile(seen[:, j], at[j]) for j in range(dimensions)])
        keys = np.sort(self.keys(sample, sample_ids), axis=0)
        self.splitters = [keys[(np.arange(1, blocks) * len(keys)) // blocks, c] for c in range(curves)]

    def keys(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The place of each vector in every ordering, one column each; vectors of one cell are told apart by their ids."""
        tie = (tx.mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - self.tie)).astype(np.int64)
        out = np.empty((len(vectors), len(self.maps)), np.int64)
        for c, (basis, lines) in enumerate(zip(self.maps, self.lines)):
            seen = vectors @ basis
            cells = np.column_stack([np.searchsorted(x, seen[:, j]) for j, x in enumerate(lines)])
            out[:, c] = hilbert(cells, self.bits) << self.tie | tie
        return out

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(x, vectors[:, j]).astype(np.uint8) for j, x in enumerate(self.levels)])

    def about(self, codes: np.ndarray) -> np.ndarray:
        """The middles of the steps that codes stand for."""
        return self.middles[np.arange(codes.shape[1]), codes]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, as arrays of floats where they are such, else of doubles."""
    v = F.col("vector")
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size(v) == (common.n if common else 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _gathered(batches):
    """(ids, vectors) of several batches together."""
    ids, found, size = [], [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):
            part = batch.slice(a, 2048)
            ids.append(part.column("vec_id").to_numpy())
            found.append(_matrix(part.column("vector")))
            size += found[-1].nbytes
            if size > GATHER:
                yield np.concatenate(ids), np.concatenate(found)
                ids, found, size = [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(found)


def _true_neighbours(own: DataFrame, probes: pa.Table, k: int) -> pa.Table:
    """(probe, vec_id, vector): the k nearest rows of each probe, by brute force in one pass; a task sends k rows a probe."""
    asked, own_ids = _matrix(probes.column("vector")), probes.column("vec_id").to_numpy()
    vector = own.schema["vector"].dataType.simpleString()

    def run(batches):
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, asked.shape[1])))] * len(asked)
        for ids, have in _gathered(batches):
            norm = (have * have).sum(axis=1)
            for i, q in enumerate(asked):
                d = norm - 2 * have @ q
                d[ids == own_ids[i]] = np.inf
                near = np.argpartition(d, k - 1)[:k] if len(d) > k else np.arange(len(d))
                d, x, v = (np.concatenate(p) for p in zip(best[i], (d[near], ids[near], have[near])))
                order = np.lexsort((x, d))[:k]
                best[i] = d[order], x[order], v[order]
        for i, (d, x, v) in enumerate(best):
            fine = np.isfinite(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(fine.sum(), i)), pa.array(d[fine]), pa.array(x[fine]), pa.array(list(v[fine]), pa.list_(pa.float64()))], ["probe", "d", "vec_id", "vector"])

    order = Window.partitionBy("probe").orderBy("d", "vec_id")
    found = own.mapInArrow(run, "probe long, d double, vec_id long, vector array<double>").withColumn("n", F.row_number().over(order))
    return found.where(F.col("n") <= k).select("probe", "vec_id", F.col("vector").cast(vector).alias("vector")).toArrow()


def window_rows(own: DataFrame, rows: DataFrame, fitted: Curves, k: int, probes: int, target: float, least: int) -> int:
    """Rows on either side of a place in which, in some ordering, `target` of the true neighbours of `probes` of the rows stand."""
    asked = rows.orderBy(F.xxhash64("vec_id", F.lit("probe")), "vec_id").limit(probes).toArrow()
    near = _true_neighbours(own, asked, k)
    if not near.num_rows:
        return least
    places = fitted.keys(_matrix(asked.column("vector")), asked.column("vec_id").to_numpy())
    theirs = fitted.keys(_matrix(near.column("vector")), near.column("vec_id").to_numpy())
    marks = [np.unique(np.concatenate([places[:, c], theirs[:, c]])) for c in range(places.shape[1])]

    def run(batches):
        counts = [np.zeros(len(m) + 1, np.int64) for m in marks]
        for ids, have in _gathered(batches):
            keys = fitted.keys(have, ids)
            for c, m in enumerate(marks):
                counts[c] += np.bincount(np.searchsorted(m, keys[:, c], side="right"), minlength=len(m) + 1)
        flat = np.concatenate(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["cell", "n"])

    counted = own.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().sort_by("cell")
    counts = np.split(counted.column("n").to_numpy(), np.cumsum([len(m) + 1 for m in marks])[:-1])
    probe = near.column("probe").to_numpy()
    apart = np.full(len(probe), np.iinfo(np.int64).max)
    for c, (m, n) in enumerate(zip(marks, counts)):
        before = np.cumsum(n)
        a, b = before[np.searchsorted(m, places[probe, c])], before[np.searchsorted(m, theirs[:, c])]
        apart = np.minimum(apart, np.abs(a - b))
    need = int(np.quantile(apart, target, method="higher")) + 1
    side = float(least)
    while side < need:
        side *= 2**0.5
    return int(side)


def _dealt(rows: DataFrame, fitted: Curves, reach: int, asks: bool) -> DataFrame:
    """(curve, block, asks, n, packed): places, ids and codes of what a task holds of each block; queries go to blocks up to `reach` away."""

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for ids, have in _gathered(batches):
            keys, codes = fitted.keys(have, ids), fitted.codes(have)
            for c, splitters in enumerate(fitted.splitters):
                order = np.argsort(keys[:, c], kind="stable")
                block = np.searchsorted(splitters, keys[order, c], side="right")
                rows = [[], [], []]
                for step in range(-reach, reach + 1):
                    to = block + step
                    at, sizes = tx.runs(to)
                    for s, n in zip(at.tolist(), sizes.tolist()):
                        if 0 <= to[s] < fitted.blocks:
                            mine = order[s : s + n]
                            raw = keys[mine, c].tobytes() + ids[mine].astype(np.int64).tobytes() + codes[mine].tobytes()
                            rows[0].append(int(to[s]))
                            rows[1].append(n)
                            rows[2].append(codec.compress(raw, asbytes=True))
                size = len(rows[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c] * size, pa.int32()), pa.array(rows[0], pa.int32()), pa.array([asks] * size), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], ["curve", "block", "asks", "n", "packed"]
                )

    return rows.mapInArrow(run, "curve int, block int, asks boolean, n int, packed binary")


def _searched(dealt: DataFrame, fitted: Curves, rows: int, most: int) -> DataFrame:
    """(rep, vec_id, about): of each query's window in each block the nearest by their codes."""
    width = len(fitted.levels)

    def unpacked(table):
        keys, ids, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, width), np.uint8)]
        for n, packed in zip(table.column("n").to_pylist(), table.column("packed").to_pylist()):
            raw = pa.decompress(packed, n * (16 + width), codec="zstd", asbytes=True)
            keys.append(np.frombuffer(raw, np.int64, n))
            ids.append(np.frombuffer(raw, np.int64, n, 8 * n))
            codes.append(np.frombuffer(raw, np.uint8, n * width, 16 * n).reshape(n, width))
        keys, ids, codes = np.concatenate(keys), np.concatenate(ids), np.concatenate(codes)
        order = np.lexsort((ids, keys))
        return keys[order], ids[order], fitted.about(codes[order])

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        places, reps, asked = unpacked(table.filter(pa.array(asks)))
        keys, ids, have = unpacked(table.filter(pa.array(~asks)))
        norm, out = (have * have).sum(axis=1), [[], [], []]
        for place, rep, q in zip(np.searchsorted(keys, places), reps, asked):
            a, b = max(0, place - rows), place + rows
            d = norm[a:b] - 2 * (have[a:b] @ q)
            near = np.argpartition(d, most - 1)[:most] if len(d) > most else np.arange(len(d))
            out[0].append(np.full(len(near), rep))
            out[1].append(ids[a:b][near])
            out[2].append(d[near] + q @ q)
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"rep": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "about": pa.array(columns[2], pa.float32())})

    return dealt.groupBy("curve", "block").applyInArrow(search, "rep long, vec_id long, about float")


def _measured(pairs: DataFrame) -> DataFrame:
    """(rep, vec_id, score) of pairs with both original vectors."""

    def run(batches):
        for batch in batches:
            apart = _matrix(batch.column("vector")) - _matrix(batch.column("asked"))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("vec_id"), pa.array(np.sqrt((apart * apart).sum(axis=1)) if batch.num_rows else np.zeros(0))], ["rep", "vec_id", "score"])

    return pairs.select("rep", "vec_id", "vector", "asked").mapInArrow(run, "rep long, vec_id long, score double")


def nearest(
    vectors: DataFrame, queries, *, id_col="vec_id", vector_col="embedding", k=10, curves=CURVES, dimensions=DIMENSIONS, bits=BITS, sample=SAMPLE, probes=PROBES, target=TARGET, least=LEAST, block_rows=BLOCK_ROWS, seed=17
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (rows for which the condition on vec_id holds) its k nearest found
    among all other rows, nearest first; score is the Euclidean distance."""
    rows = usable(vectors, id_col, vector_col)
    with scratch() as keep:
        same = Window.partitionBy("vector").orderBy("vec_id")
        own = keep(rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n"), "vectors")
        asked = rows.where(queries)
        reps = keep(asked.groupBy("vector").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "vector"), "queries")
        total = own.count()
        if not total or not reps.limit(1).count():
            return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        taken = own.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / total)).toArrow().sort_by("vec_id")
        if not taken.num_rows:
            taken = own.orderBy("vec_id").limit(1).toArrow()
        fitted = Curves(_matrix(taken.column("vector")), taken.column("vec_id").to_numpy(), max(1, total // block_rows), curves, dimensions, bits, seed)
        # windows are set by rows that are no queries, so that what queries find tells how good they are
        outside = own.join(reps.select("vec_id"), "vec_id", "left_anti")
        side = window_rows(own, outside if outside.limit(1).count() else reps, fitted, k, probes, target, least)
        reach = min(fitted.blocks - 1, -(-side // block_rows))
        most = 2 * (k + 1)
        dealt = _dealt(own, fitted, 0, False).union(_dealt(reps, fitted, reach, True))
        found = _searched(dealt, fitted, side, most).groupBy("rep", "vec_id").agg(F.min("about").alias("about"))
        order = Window.partitionBy("rep").orderBy("about", "vec_id")
        found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("rep", "vec_id")
        pairs = found.join(own, "vec_id").join(reps.select(F.col("vec_id").alias("rep"), F.col("vector").alias("asked")), "rep")
        scored = _measured(pairs).groupBy("rep", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("rep").orderBy("score", "vec_id")
        scored = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
        named = asked.join(reps.select("vector", F.col("vec_id").alias("rep")), "vector").select("rep", F.col("vec_id").alias("query_id"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        out = named.join(scored, "rep").where("vec_id <> query_id").withColumn("rank", F.row_number().over(order).cast("int"))
        return materialise(out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
