"""Cross-tokenizer alignment: which tokens of one vocabulary overlap which of another, and how often in the whole corpus.

Text with a space before it is encoded by a byte-level vocabulary (A) and a piece vocabulary (B).
The tokens of B form a static interval index over byte offsets; for each token of A two bisections
tell the range of B tokens that it overlaps. A gap between tokens that no token of either side spans
becomes the boundary of a group.

The corpus counts go by chunks of bounded size. Each task writes the links of its chunks in order, two
bytes each as a rule: which of the chunk's distinct pairs, and whether the A token and the B token are
new, from which tokens and groups are read off again. Distinct pairs with their numbers of links are
added up over chunks (combined before the shuffle), and each chunk gets the totals of its own pairs
back. No table grows with one document or pair beyond its chunk; a text larger than a chunk is one.
The tables of links and of pair counts stay in the shared folder, since the result reads them.

Null and empty texts, and texts whose tokens do not spell them again byte by byte, have no tokens:
zeros, and empty groups. Strings of special tokens are plain text. Rows that repeat an id count and
come back each for itself. Only id and text are read, so further columns never clash.
"""

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from . import agenda, bpe, pieces, token_counts
from . import text as tx

#: Bytes of text in a chunk.
CHUNK = 1 << 20
#: Words of each side that a worker remembers.
MEMO = 120_000


class ByteEncoder:
    """Ids under a byte-level vocabulary, special strings as plain text, by agendas of pairs; long words by the pair index."""

    def __init__(self, path: str):
        spec = bpe._load(path)
        self.v = bpe.Vocabulary(spec)
        self.ascii, self.full = re.compile(token_counts.ASCII), regex.compile(token_counts.PATTERN)
        alphabet = token_counts.byte_alphabet()
        special = {t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = [b""] * self.v.size
        for token, i in spec["model"]["vocab"].items():
            if i not in special:
                self.bytes[i] = bytes(alphabet[c] for c in token)
        left, right = self.v.parts.T
        self.agendas = agenda.Agendas(left, right, self.v.made, np.arange(len(self.v.made)), self.v.size)
        self.known = agenda.Known(self._words, MEMO)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw])
        short = np.flatnonzero(sizes <= agenda.SHORT).tolist()
        symbols, left = self.agendas.merge(self.v.inner[np.frombuffer(b"".join([raw[i] for i in short]), np.uint8)], sizes[short])
        if len(short) == len(words):
            return symbols, left
        at = np.flatnonzero(sizes > agenda.SHORT).tolist()
        long = dict(zip(at, bpe.PairIndex(self.v, [raw[i] for i in at]).merge().ids()))
        parts = iter(np.split(symbols, np.cumsum(left)[:-1])) if short else iter(())
        each = [long[i] if i in long else next(parts) for i in range(len(words))]
        return np.concatenate(each), np.array([len(x) for x in each])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.known.ids([(self.ascii if t.isascii() else self.full).findall(t) for t in texts])


class IntervalIndex:
    """Tokens one after another as byte intervals, for stabbing queries by bisection."""

    def __init__(self, ends: np.ndarray):
        self.ends = ends
        self.starts = np.concatenate([[0], ends[:-1]])

    def stabbed(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first interval that each query overlaps, and the one after the last."""
        return np.searchsorted(self.ends, starts, side="right"), np.searchsorted(self.starts, ends, side="left")


class Aligned:
    """The tokens of both sides of a chunk of texts, laid end to end, with the links between them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        self.a, self.b = a, b
        self.index = IntervalIndex(np.cumsum(size_b[b]))
        self.ends = np.cumsum(size_a[a])
        self.first, last = self.index.stabbed(np.concatenate([[0], self.ends[:-1]]), self.ends) if len(a) else (np.zeros(0, np.int64),) * 2
        self.n_links = last - self.first

    def links(self, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """a * many + b of every link, A token by A token, and whether its A token and its B token are new. Where both are,
        no token spans the gap before them."""
        at_b = np.repeat(self.first, self.n_links) + tx.spread(self.n_links)
        fresh_a = np.zeros(len(at_b), bool)
        fresh_a[np.cumsum(self.n_links) - self.n_links] = True
        return np.repeat(self.a.astype(np.int64), self.n_links) * many + self.b[at_b], fresh_a, np.diff(at_b, prepend=-1) > 0


class Names:
    """Groups as text: `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, many_a: int, many_b: int):
        self.table = np.array([f"{i}{mark}" for many, marks in ((many_a, ",|"), (many_b, ",;")) for mark in marks for i in range(many)], object)
        self.many_a, self.many_b = many_a, many_b

    def tokens(self, a, b, last_a, last_b) -> np.ndarray:
        """The ids of both sides in the order of the text form, each with the mark behind it; last_a, last_b: the last token of each group."""
        na, nb = len(a), len(b)
        ends_a, ends_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
        ends_a[last_a] = ends_b[last_b] = 1
        code_a = a + ends_a * self.many_a
        code_b = b + ends_b * self.many_b + 2 * self.many_a
        # an A token stands behind the B tokens of the groups before, a B token behind the A tokens of its own group
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        out = np.empty(na + nb, np.int64)
        out[np.arange(na) + np.concatenate([[0], last_b + 1])[group_a]] = code_a
        out[np.arange(nb) + (last_a + 1)[group_b]] = code_b
        return self.table[out]


def _spelled(ids: np.ndarray, raw: np.ndarray) -> bytes:
    return b"".join(raw[ids])


class Sides:
    """Both vocabularies with the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteEncoder(a), pieces.Encoder(b, MEMO)
        self.raw_a, self.raw_b = np.array(self.a.bytes, object), np.array(self.b.v.bytes, object)
        self.size_a, self.size_b = (np.array([len(x) for x in raw]) for raw in (self.raw_a, self.raw_b))

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The tokens of both sides, none for a text that either does not spell again."""
        none = np.zeros(0, np.int32)
        spaced = [" " + t if t else "" for t in texts]
        a, b = self.a.encode(spaced), self.b.encode([t or "" for t in texts])
        for i, t in enumerate(spaced):
            want = t.encode()
            if not want or _spelled(a[i], self.raw_a) != want or _spelled(b[i], self.raw_b) != want:
                a[i] = b[i] = none
        return a, b


@lru_cache(maxsize=1)
def _sides(a: str, b: str) -> Sides:
    """Both sides in a worker: the words that they know serve the tasks that follow."""
    return Sides(a, b)


def _encoded(docs: DataFrame, a: str, b: str, chunk: int, kind: str) -> DataFrame:
    """One row for each chunk: ids, how many links each text has, the links, the distinct pairs and their numbers of links."""

    def run(batches):
        from pyspark import TaskContext

        sides = None
        part, n = TaskContext.get().partitionId(), 0
        for batch in _gathered(batches, chunk):
            sides = sides or _sides(a, b)
            one, two = sides.encode(batch.column("text").to_pylist())
            x = Aligned(np.concatenate(one), np.concatenate(two), sides.size_a, sides.size_b)
            pairs, fresh_a, fresh_b = x.links(len(sides.raw_b))
            pair, which, links = np.unique(pairs, return_inverse=True, return_counts=True)
            ends = np.concatenate([[0], np.cumsum(x.n_links)])[np.cumsum([len(i) for i in one])]
            row = [
                pa.array([(part << 32) + n]),
                pa.array([batch.column("doc_id").to_pylist()], pa.list_(batch.schema.field("doc_id").type)),
                pa.array([np.diff(ends, prepend=0)], pa.list_(pa.int64())),
                pa.array([_packed(which.astype(np.uint32) << 2 | fresh_b.astype(np.uint32) << 1 | fresh_a)], pa.binary()),
                pa.array([pair], pa.list_(pa.int64())),
                pa.array([links], pa.list_(pa.int64())),
            ]
            n += 1
            yield pa.RecordBatch.from_arrays(row, ["chunk", "ids", "n_links", "codes", "pair", "links"])

    return docs.mapInArrow(run, f"chunk long, ids array<{kind}>, n_links array<long>, codes binary, pair array<long>, links array<long>")


def _packed(codes: np.ndarray) -> bytes:
    """The width of a code in bytes, the size, and the codes compressed."""
    width = 2 if codes.max(initial=0) < 1 << 16 else 4
    raw = codes.astype(f"<u{width}").tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    raw = pa.decompress(packed[9:], int.from_bytes(packed[1:9], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, f"<u{packed[0]}").astype(np.int64)


def _gathered(batches, limit: int):
    """Batches of about `limit` bytes of text, from smaller and larger ones."""
    held, size = [], 0
    for batch in tx.chunks(batches, limit=limit):
        own = len(tx.as_bytes(batch.column("text"))[0])
        if held and size + own > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pair_counts(encoded: DataFrame, many_b: int) -> DataFrame:
    """(pair, count, best): the links of every id pair in the corpus, and whether no pair of its B id has more."""
    rows = encoded.select(F.explode(F.arrays_zip("pair", "links")).alias("p"))
    counts = rows.groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.links").alias("count"))
    top = counts.groupBy((F.col("pair") % many_b).alias("b")).agg(F.max("count").alias("top"))
    return counts.withColumn("b", F.col("pair") % many_b).join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, a: str, b: str, *, id_col="doc_id", text_col="text", chunk=CHUNK) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every text.

    n_links: pairs of an A and a B token that share bytes; n_best: those whose id pair is the most
    frequent of its B id in the whole corpus; count_sum: the corpus counts of the id pairs of all
    links; groups: the ids of both sides, group by group. a, b: a byte-level vocabulary and a piece
    vocabulary that every executor and the driver can open.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    many_b = len(pieces.Vocabulary(b).bytes)
    fields = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"

    def finish(chunk_: pa.Table, totals: pa.Table) -> pa.Table:
        totals = totals.sort_by("pair")
        pair, count, best = (totals.column(c).to_numpy() for c in ("pair", "count", "best"))
        row = chunk_.to_batches()[0]
        return _facts(_unpacked(row.column("codes")[0].as_py()), row.column("n_links").flatten().to_numpy(), row.column("ids").flatten(), pair, count, best, many_b)

    encoded = materialise(_encoded(source, a, b, chunk, kind), "links")
    counts = materialise(pair_counts(encoded, many_b), "pairs")
    own = encoded.select(F.col("chunk").alias("of"), F.explode("pair").alias("pair")).join(counts, "pair")
    chunks = encoded.select(F.col("chunk").alias("at"), "ids", "n_links", "codes")
    return chunks.groupBy("at").cogroup(own.groupBy("of")).applyInArrow(finish, fields).withColumnRenamed("doc_id", id_col)


@lru_cache(maxsize=1)
def _names(many_a: int, many_b: int) -> Names:
    return Names(many_a, many_b)


def _facts(codes, n_links, ids: pa.Array, pair, count, best, many_b: int) -> pa.Table:
    """The result rows of one chunk, from its links in order and the totals of its pairs in order."""
    which, fresh_a, fresh_b = codes >> 2, codes & 1 > 0, codes & 2 > 0
    bounds = np.concatenate([[0], np.cumsum(n_links)])

    def added(values):
        return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])

    at_a, at_b = np.flatnonzero(fresh_a), np.flatnonzero(fresh_b)
    group = np.cumsum(fresh_a & fresh_b)
    a, b = pair[which[at_a]] // many_b, pair[which[at_b]] % many_b
    last_a, last_b = (np.flatnonzero(np.diff(group[at], append=-1)) for at in (at_a, at_b))
    n_a, n_b = added(fresh_a), added(fresh_b)
    words = _names(int(a.max(initial=0)) // 65536 * 65536 + 65536, many_b).tokens(a, b, last_a, last_b).tolist()
    ends = np.cumsum(n_a + n_b)
    text = ["".join(words[e - n : e])[:-1] for n, e in zip((n_a + n_b).tolist(), ends.tolist())]
    return pa.table(
        {
            "doc_id": ids, "n_a": n_a, "n_b": n_b, "n_groups": added(fresh_a & fresh_b), "n_links": n_links,
            "n_best": added(best[which]), "count_sum": added(count[which]), "groups": pa.array(text, pa.string()),
        }
    )
