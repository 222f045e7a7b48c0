"""Benchmark decontamination by pigeonhole edit matching.

An item of m words may occur in a document with up to k = m * rate word edits (inserted, deleted or
changed words). It is split into k + 1 pieces; k edits cannot touch all of them, so every occurrence
holds at least one piece unchanged. Pieces are found exactly by hash, and each hit is verified with
Myers' bit-parallel distance around the place where the piece puts the item.

Words are runs of letters, marks and digits of any script, compared in lower case. Items without a
word, null texts and null ids take no part. Items of fewer than `least_words` words are found too but
marked `short`: they cannot tell a leak from chance, and clean() drops no document for them alone.
Equal items are each reported; of several occurrences of an item in one document the closest is,
then the first. Whole texts are searched. Only ids and texts are read, so further columns never clash.

Items of up to `block_bytes` together go with the tasks, and documents are read once and not
shuffled. Above that pieces and the places that hold them are joined by hash: documents send only
places that pass a filter of fixed size, and only documents with a hit are verified.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, scratch
from . import text as tx

RATE = 1 / 6
LEAST_WORDS = 5
BLOCK_BYTES = 8 << 20
#: Bits of the filter that keeps places without a piece from travelling, and of a part of it.
FILTER_BITS, PART_BITS = 1 << 27, 1 << 19
SCHEMA = "doc_id long, item_id long, distance int, budget int, first_word int, last_word int, short boolean"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.bool_()]

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts in lower case with spaces for all that is no letter, mark or digit: bytes, and where each text begins."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    data, _ = tx.as_bytes(column)
    if len(data) and data.max() > 127:
        column = pc.replace_substring_regex(column, r"[^\p{L}\p{M}\p{N}\x00-\x7f]", " ")
    data, offsets = tx.as_bytes(column)
    return _PLAIN[data], offsets


class Words:
    """Hashes of the words of texts, and of their runs."""

    def __init__(self):
        self.hasher, self.grams = tx.Hasher(), tx.Hasher(0x9FB21C651E98DF25)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts in a row, and the index of the text of each."""
        data, offsets = plain(column)
        starts, ends, owner = tx.word_bounds(data, offsets)
        return (self.hasher.words(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)), owner

    def runs(self, words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of `size` words of one text begin, and their hashes."""
        at = np.arange(max(0, len(words) - size + 1))
        at = at[owner[at] == owner[at + size - 1]] if len(at) else at
        return at, self.grams.of(self.grams.totals(words), at, at + size, seed=size)


class Distance:
    """Myers' bit-parallel search for one pattern of hashed words."""

    def __init__(self, pattern: list[int]):
        self.m = len(pattern)
        self.full, self.top = (1 << self.m) - 1, 1 << (self.m - 1)
        self.at: dict[int, int] = {}
        for i, w in enumerate(pattern):
            self.at[w] = self.at.get(w, 0) | 1 << i

    def ends(self, words: list[int]):
        """The smallest distance between the pattern and a stretch that ends after each word."""
        plus, minus, score, full = self.full, 0, self.m, self.full
        for w in words:
            same = self.at.get(w, 0)
            vertical = same | minus
            across = (((same & plus) + plus) ^ plus) | same
            up, down = minus | ~(across | plus) & full, plus & across
            score += bool(up & self.top) - bool(down & self.top)
            up, down = up << 1 & full, down << 1 & full
            plus, minus = down | ~(vertical | up) & full, up & vertical
            yield score


def edges(words: int, rate: float) -> np.ndarray:
    """Where the pieces of an item begin and end."""
    return np.linspace(0, words, int(words * rate) + 2).astype(int)


class Item:
    def __init__(self, item_id: int, words: np.ndarray, rate: float, least_words: int):
        self.id, self.n, self.budget, self.short = item_id, len(words), int(len(words) * rate), len(words) < least_words
        self.words, self.both = words, None

    def closest(self, words: np.ndarray, guesses) -> tuple | None:
        """(distance, first word, last word) of the closest occurrence in a text near one of the places at which it may begin."""
        regions: list[list[int]] = []
        for guess in sorted(guesses):
            lo, hi = max(guess - self.budget, 0), min(guess + self.n + self.budget, len(words))
            if regions and lo <= regions[-1][1] - self.n:
                regions[-1][1] = max(hi, regions[-1][1])
            else:
                regions.append([lo, hi])
        self.both = self.both or (Distance(self.words.tolist()), Distance(self.words[::-1].tolist()))
        ahead, back = self.both
        best = None
        for lo, hi in regions:
            part = words[lo:hi].tolist()
            d, end = min(((d, e) for e, d in enumerate(ahead.ends(part))), default=(self.budget + 1, 0))
            if d > self.budget or best and best[0] <= d:
                continue
            tail = part[max(0, end + 1 - self.n - self.budget) : end + 1][::-1]
            length = next(n for n, x in enumerate(back.ends(tail), 1) if x == d) if d < self.n else 1
            best = (d, lo + end + 1 - length, lo + end)
        return best

    def row(self, doc_id, found):
        return doc_id, self.id, found[0], self.budget, found[1], found[2], self.short


class Matcher:
    """Pieces of the items by their size, and the search for them in chunks of texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least_words: int):
        self.words = Words()
        words, owner = self.words.of(pa.array([t for _, t in items], pa.large_string()))
        parts = np.split(words, np.searchsorted(owner, np.arange(1, len(items))))
        self.items = [Item(i, w, rate, least_words) for (i, _), w in zip(items, parts) if len(w)]
        pieces: dict[int, list] = {}
        for n, item in enumerate(self.items):
            cuts = edges(item.n, rate)
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                pieces.setdefault(b - a, []).append((n, a, self.words.runs(item.words[a:b], np.zeros(b - a, int), b - a)[1][0]))
        self.pieces = {}
        for size, found in sorted(pieces.items()):
            keys = np.array([k for _, _, k in found], np.uint64)
            order = np.argsort(keys, kind="stable")
            screen = np.zeros(1 << 20, bool)
            screen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.pieces[size] = keys[order], np.array([x[:2] for x in found], np.int64)[order], screen

    def search(self, column: pa.Array):
        """(text, item, (distance, first word, last word)) of the closest occurrence of every item in every text."""
        words, owner = self.words.of(column)
        counts = np.bincount(owner, minlength=len(column))
        base = np.cumsum(counts) - counts
        guesses: dict[tuple[int, int], set] = {}
        for size, (known, of, screen) in self.pieces.items():
            at, keys = self.words.runs(words, owner, size)
            near = screen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)]
            at, keys = at[near], keys[near]
            low, n = np.searchsorted(known, keys), 0
            n = np.searchsorted(known, keys, side="right") - low
            at, which = np.repeat(at, n), np.repeat(low, n) + tx.spread(n)
            item, offset = of[which].T
            text = owner[at]
            for t, i, guess in zip(text.tolist(), item.tolist(), (at - base[text] - offset).tolist()):
                guesses.setdefault((t, i), set()).add(guess)
        for (t, i), places in guesses.items():
            if found := self.items[i].closest(words[base[t] : base[t] + counts[t]], places):
                yield t, self.items[i], found


def _batch(rows):
    columns = list(zip(*rows)) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, TYPES)], NAMES)


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", rate=RATE, least_words=LEAST_WORDS, block_bytes=BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, budget, first_word, last_word, short) for every item that occurs in a document within its budget."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if total > block_bytes:
        return _by_join(source, items, rate, least_words)
    rows = sorted((r.item_id, r.text) for r in items.collect())

    def run(batches):
        matcher = None
        for batch in tx.chunks(batches):
            matcher = matcher or Matcher(rows, rate, least_words)
            ids = batch.column("doc_id").to_pylist()
            yield _batch([item.row(ids[t], found) for t, item, found in matcher.search(batch.column("text"))])

    return source.mapInArrow(run, SCHEMA)


def _pieces(items, rate):
    """(piece, size, item_id, at) of every piece of every item."""

    def run(batches):
        hashed = Words()
        for batch in tx.chunks(batches):
            words, owner = hashed.of(batch.column("text"))
            rows = []
            for item_id, w in zip(batch.column("item_id").to_pylist(), np.split(words, np.searchsorted(owner, np.arange(1, batch.num_rows)))):
                cuts = edges(len(w), rate).tolist() if len(w) else []
                rows += [(int(hashed.runs(w[a:b], np.zeros(b - a, int), b - a)[1].view(np.int64)[0]), b - a, item_id, a) for a, b in zip(cuts, cuts[1:])]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32()))], ["piece", "size", "item_id", "at"])

    return items.mapInArrow(run, "piece long, size int, item_id long, at int")


def _filter(pieces) -> np.ndarray:
    """One bit for each remainder of a piece's hash, FILTER_BITS in all."""
    slot = F.pmod("piece", F.lit(FILTER_BITS))
    slots = pieces.select(slot.alias("slot")).distinct().select((F.col("slot") / PART_BITS).cast("int").alias("part"), (F.col("slot") % PART_BITS).cast("int").alias("bit"))

    def run(table: pa.Table) -> pa.Table:
        bits = np.zeros(PART_BITS, bool)
        bits[table.column("bit").to_numpy()] = True
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in slots.groupBy("part").applyInArrow(run, "part int, bits binary").collect():
        out[r.part * PART_BITS // 8 : (r.part + 1) * PART_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _by_join(source, items, rate, least_words):
    """leaks() for any number of items."""
    with scratch() as keep:
        pieces = keep(_pieces(items, rate), "pieces")
        sizes = sorted(r.size for r in pieces.select("size").distinct().collect())
        known = source.sparkSession.sparkContext.broadcast(_filter(pieces))

        def hits(batches):
            hashed = Words()
            for batch in tx.chunks(batches):
                words, owner = hashed.of(batch.column("text"))
                counts = np.bincount(owner, minlength=batch.num_rows)
                base = np.cumsum(counts) - counts
                for size in sizes:
                    at, keys = hashed.runs(words, owner, size)
                    slot = (keys.view(np.int64) % FILTER_BITS).astype(np.int64)
                    near = known.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 == 1
                    at, keys = at[near], keys[near]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("doc_id").take(pa.array(owner[at])), pa.array((at - base[owner[at]]).astype(np.int32))], ["piece", "doc_id", "place"])

        # written, so that adaptive execution may split a piece that very many documents hold
        found = keep(source.mapInArrow(hits, "piece long, doc_id long, place int"), "hits")
        guesses = found.join(pieces, "piece").groupBy("doc_id", "item_id").agg(F.collect_set(F.col("place") - F.col("at")).alias("guesses"))
        wanted = keep(guesses.join(items.withColumnRenamed("text", "item"), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item", "guesses")).alias("items")), "wanted")

        def verify(batches):
            hashed = Words()
            for batch in tx.chunks(batches):
                words, owner = hashed.of(batch.column("text"))
                rows = []
                for n, (doc_id, asked) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("items").to_pylist())):
                    mine = words[np.searchsorted(owner, n) : np.searchsorted(owner, n + 1)]
                    for x in asked:
                        item = Item(x["item_id"], hashed.of(pa.array([x["item"]], pa.large_string()))[0], rate, least_words)
                        if hit := item.closest(mine, x["guesses"]):
                            rows.append(item.row(doc_id, hit))
                yield _batch(rows)

        return materialise(source.join(wanted, "doc_id").mapInArrow(verify, SCHEMA), "leaks")


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", **options) -> DataFrame:
    """The documents in which no item occurs but short ones, all their columns as they were. A document whose id is null stays."""
    found = leaks(docs, benchmark, id_col=id_col, **options).where("NOT short").select(F.col("doc_id").alias("_leaking")).distinct()
    return docs.join(found, F.col(id_col).cast("long") == F.col("_leaking"), "left_anti")
