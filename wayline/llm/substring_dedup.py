"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is `window` consecutive words of one document. Its minimiser is the least hash among its
short word runs; neighbouring windows mostly share it, and the stretch of windows that do (a
super-k-mer) travels as one packed string to the bucket of its minimiser. Equal windows have equal
minimisers, so they meet in one bucket, where sorting window hashes counts them exactly and finds
the smallest document of each. A minimiser that would fill a bucket by itself (a passage that very
many documents hold) does not travel so: its windows go one by one, keyed by their own hash, with
the smallest document combined before the shuffle; no bucket outgrows its size.

Windows are told apart by 128 bits of hash. Null and empty texts have no words. A document whose id
is null keeps its text. Ids name documents: rows that repeat an id must repeat its text. Whole
texts, however long, are read; only id and text are, so further columns never clash.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise
from . import text as tx

WINDOW = 50
RUN = 4
#: Words that a bucket holds, about, and the most minimisers whose windows travel one by one (8 bytes each in tasks).
BUCKET_WORDS = 1_000_000
MOST_HOT = 1_000_000
CHUNK = 1 << 20
#: Bytes of strings that a task gathers before it compresses and sends them.
GATHER = 24 << 20


class Windows:
    """Windows of a chunk of texts: their minimisers, their 128-bit hashes and the super-k-mers they form."""

    def __init__(self, window: int, run: int):
        self.window, self.run = window, run
        self.bytes = [tx.Hasher(), tx.Hasher(0xC2B2AE3D27D4EB4F)]
        self.words = [tx.Hasher(0x165667B19E3779F9), tx.Hasher(0x27D4EB2F165667C5)]

    def load(self, data, starts, ends, owner):
        self.data, self.starts, self.ends, self.owner = data, starts, ends, owner
        self.sums = [w.totals(b.words(data, starts, ends)) for b, w in zip(self.bytes, self.words)]
        at = np.arange(max(0, len(starts) - self.window + 1))
        self.at = at[owner[at] == owner[at + self.window - 1]]
        return self

    def hashes(self, at=None):
        at = self.at if at is None else at
        return [w.of(s, at, at + self.window) for w, s in zip(self.words, self.sums)]

    def minimisers(self):
        n = len(self.starts)
        if n < self.window:
            return np.zeros(0, np.uint64)
        at = np.arange(n - self.run + 1)
        least = self.words[0].of(self.sums[0], at, at + self.run, seed=1)
        need, width = self.window - self.run + 1, 1
        while 2 * width <= need:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < need:
            least = np.minimum(least[: len(least) - (need - width)], least[need - width :])
        return least[self.at]

    def super_kmers(self):
        """(minimiser, first word, windows) of every stretch of windows of one document that share a minimiser."""
        least = self.minimisers()
        if not len(least):
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), none, none
        own = self.owner[self.at]
        cut = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (own[1:] != own[:-1])]))
        return least[cut], self.at[cut], np.diff(np.append(cut, len(least)))


def _loaded(batches, window, run):
    """Each chunk's document ids, the number of its texts' first words, and its windows."""
    windows = Windows(window, run)
    for batch in tx.chunks(batches, limit=CHUNK):
        data, starts, ends, owner = tx.joined_words(*tx.as_bytes(batch.column("text")))
        counts = np.bincount(owner, minlength=batch.num_rows)
        yield batch.column("doc_id").to_numpy(), np.cumsum(counts) - counts, windows.load(data, starts, ends, owner)


def _loads(docs, window, run):
    def emit(batches):
        for _, _, w in _loaded(batches, window, run):
            least, _, counts = w.super_kmers()
            key, back = np.unique(least, return_inverse=True)
            words = np.bincount(back, weights=counts + window - 1, minlength=len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(words)], ["minimiser", "words"])

    return docs.mapInArrow(emit, "minimiser long, words long").groupBy("minimiser").agg(F.sum("words").alias("words"))


def _packed(docs, window, run, buckets, hot):
    """(bucket, facts, packed): the super-k-mers that a task sends to a bucket, their strings compressed together;
    facts: document, first word and windows of each."""

    def emit(batches):
        gathered, size = {}, 0
        for ids, base, w in _loaded(batches, window, run):
            least, first, counts = w.super_kmers()
            cold = ~np.isin(least, hot)
            least, first, counts = least[cold], first[cold], counts[cold]
            bucket = (tx.mixed(least, 7) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, first, counts = bucket[order], first[order], counts[order]
            raw, own = w.data.tobytes(), w.owner[first]
            a, b = w.starts[first], w.ends[first + counts + window - 2]
            size += int((b - a).sum())
            a, b = a.tolist(), b.tolist()
            facts = np.column_stack([ids[own].astype(np.int64), first - base[own], counts])
            at, sizes = tx.runs(bucket)
            for s, e in zip(at.tolist(), (at + sizes).tolist()):
                rows, texts = gathered.setdefault(int(bucket[s]), ([], []))
                rows.append(facts[s:e])
                texts += [raw[x:y] for x, y in zip(a[s:e], b[s:e])]
            if size > GATHER:
                yield from _sent(gathered)
                gathered, size = {}, 0
        yield from _sent(gathered)

    return docs.mapInArrow(emit, "bucket long, facts binary, packed binary")


def _sent(gathered):
    codec = pa.Codec("zstd", compression_level=4)
    for bucket, (rows, texts) in gathered.items():
        text = b"\n".join(texts)
        packed = len(text).to_bytes(8, "little") + codec.compress(text, asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([np.concatenate(rows).tobytes()], pa.binary()), pa.array([packed], pa.binary())], ["bucket", "facts", "packed"])


def _in_buckets(packed, window, run):
    """(doc_id, first, windows): stretches of windows that also start in a smaller document, found within each bucket."""

    def count(table: pa.Table) -> pa.Table:
        texts = b"\n".join(pa.decompress(p[8:], int.from_bytes(p[:8], "little"), codec="zstd", asbytes=True) for p in table.column("packed").to_pylist())
        doc, first, counts = np.frombuffer(b"".join(table.column("facts").to_pylist()), np.int64).reshape(-1, 3).T
        data = np.frombuffer(texts, np.uint8)
        starts, ends, _ = tx.word_bounds(data, np.array([0, len(data)]))
        w = Windows(window, run).load(data, starts, ends, np.zeros(len(starts), np.int64))
        words = counts + window - 1
        at = np.repeat(np.cumsum(words) - words, counts) + tx.spread(counts)
        own = np.repeat(np.arange(len(doc)), counts)
        h1, h2 = w.hashes(at)
        order = np.lexsort((doc[own], h2, h1))
        s1, s2 = h1[order], h2[order]
        head = np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
        smallest = doc[own][order][head][np.cumsum(head) - 1]
        repeated = np.empty(len(at), bool)
        repeated[order] = doc[own][order] > smallest
        hit = np.flatnonzero(repeated)
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(own[hit]) != 0)])) if len(hit) else hit
        lead = hit[cut]
        place = first[own[lead]] + tx.spread(counts)[lead]
        return pa.table({"doc_id": doc[own[lead]], "first": place, "windows": np.diff(np.append(cut, len(hit))).astype(np.int64)})

    return packed.groupBy("bucket").applyInArrow(count, "doc_id long, first long, windows long")


def _one_by_one(docs, window, run, hot):
    """The same for the windows of hot minimisers, each keyed by its own hash."""

    def emit(batches):
        for ids, base, w in _loaded(batches, window, run):
            at = w.at[np.isin(w.minimisers(), hot)]
            h1, h2 = w.hashes(at)
            own = w.owner[at]
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[own].astype(np.int64)), pa.array(at - base[own])], ["h1", "h2", "doc_id", "first"])

    windows = docs.mapInArrow(emit, "h1 long, h2 long, doc_id long, first long")
    # written first, so that adaptive execution may split the windows of one hash between tasks: many documents share it
    smallest = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest")).where("smallest < largest").drop("largest")
    smallest = materialise(smallest, "smallest")
    return windows.join(smallest, ["h1", "h2"]).where("doc_id > smallest").select("doc_id", "first", F.lit(1).cast("long").alias("windows"))


def repeated_spans(docs: DataFrame, *, id_col="doc_id", text_col="text", window=WINDOW, run=RUN, bucket_words=BUCKET_WORDS) -> DataFrame:
    """(id, first, windows): stretches of windows (of word number `first` on) whose words also start in a document with a smaller id."""
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    run = min(run, window)
    loads = materialise(_loads(source, window, run).where(F.col("words") > 0), "minimisers")
    total = loads.agg(F.sum("words")).first()[0] or 0
    buckets = max(1, -(-total // bucket_words))
    bound = max(bucket_words // 4, total // MOST_HOT)  # at most MOST_HOT minimisers can be above it
    hot = np.array([r.minimiser for r in loads.where(F.col("words") > bound).select("minimiser").collect()], np.int64).view(np.uint64)
    discard(loads)
    spans = _in_buckets(_packed(source, window, run, buckets, hot), window, run)
    spans = spans.union(_one_by_one(source, window, run, hot)) if len(hot) else spans
    return spans.withColumnRenamed("doc_id", id_col)


def _with_spans(docs, id_col, text_col, window, run, bucket_words):
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, window=window, run=run, bucket_words=bucket_words)
    spans = spans.groupBy(F.col(id_col).alias("_id")).agg(F.collect_list(F.struct("first", "windows")).alias("_spans"))
    return docs.join(spans, F.col(id_col).cast("long") == F.col("_id"), "left").drop("_id")


def _kept(texts, spans, window):
    """For each text the number of its words, how many go, and what stays as bytes."""
    data, starts, ends, owner = tx.joined_words(*tx.as_bytes(texts))
    counts = np.bincount(owner, minlength=len(texts))
    base, lists = np.cumsum(counts) - counts, spans.to_pylist()
    change = np.zeros(len(starts) + 1, np.int64)
    for b, own in zip(base.tolist(), lists):
        for s in own or ():
            change[b + s["first"]] += 1
            change[b + s["first"] + s["windows"] + window - 1] -= 1
    gone = np.cumsum(change[:-1]) > 0
    raw, kept = data.tobytes(), []
    for b, n, own in zip(base.tolist(), counts.tolist(), lists):
        if not own:
            kept.append(raw[starts[b] : ends[b + n - 1]] if n else b"")
            continue
        at = np.flatnonzero(~gone[b : b + n]) + b
        edge = np.flatnonzero(np.diff(at) != 1)
        heads, tails = np.append(at[:1], at[edge + 1]), np.append(at[edge], at[-1:])
        kept.append(b" ".join(raw[starts[h] : ends[t]] for h, t in zip(heads, tails)))
    return counts, np.bincount(owner[gone], minlength=len(texts)), kept


def remove_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", window=WINDOW, run=RUN, bucket_words=BUCKET_WORDS) -> DataFrame:
    """(id, n_words, n_removed, kept, kept_sha256) of every document: each word under a window that also starts in a
    document with a smaller id is removed; kept words are joined by one space. Windows are judged on the input."""
    source = _with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", window, run, bucket_words)

    def cut(batches):
        for batch in tx.chunks(batches):
            counts, removed, kept = _kept(batch.column("text"), batch.column("_spans"), window)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    out = source.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string, kept_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)


def without_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", window=WINDOW, run=RUN, bucket_words=BUCKET_WORDS) -> DataFrame:
    """Every document with all its columns; a text from which words go becomes its kept words, any other stays as it was."""
    source = _with_spans(docs, id_col, text_col, window, run, bucket_words)
    names = list(docs.columns)
    place = names.index(text_col)

    def cut(batches):
        for batch in tx.chunks(batches, text_col):
            texts = batch.column(text_col)
            _, removed, kept = _kept(texts, batch.column("_spans"), window)
            new = [k.decode() if n else t for k, n, t in zip(kept, removed, texts.to_pylist())]
            columns = [batch.column(c) for c in names]
            columns[place] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(cut, docs.schema)
