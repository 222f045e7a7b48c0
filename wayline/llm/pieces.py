"""Encoding and decoding by a merge-type piece vocabulary with byte fallback.

A score-ordered agenda holds the adjacent symbol pairs whose union is a piece: the best score comes
first, of equal scores the leftmost pair, and every merge puts its two new neighbours on the agenda.
Long stretches have a heap each, short ones advance together, one entry of each agenda a round.
Where no piece can cross (before a space, between a letter and a sign, at a character that no longer
piece holds) a text is cut into stretches first; one seen before is not encoded again while memory
allows. differences() holds the result against the
library, Arrow batch by Arrow batch.

Null and empty texts give no ids. Strings that look like special or byte pieces are ordinary text. A
character without a piece becomes its UTF-8 bytes. Texts are taken whole; results do not depend on
how they are batched, equal rows give equal ids. When decoded, begin, end and unlisted ids and null
lists are nothing, the unknown id is its surface, bytes that are no UTF-8 become U+FFFD one by one.
Only the id and the column worked on are read, so further columns never clash.
"""

import codecs
import heapq
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import agenda
from . import text as tx
from .bpe import _lists, _narrow

SPACE = "▁"
MEMO = 400_000
#: Fixed values of the vocabulary format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2


def _fields(data: bytes):
    """(number, value) of every field of a protocol message: integers, or the bytes of the others."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield tag >> 3, data[at : at + size]
        at += size


class Vocabulary:
    """Pieces, scores and bytes of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        trainer, plain = {}, {}
        pieces = []
        for number, value in parts:
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                plain = dict(_fields(value))
        if trainer.get(3, 1) != MERGES or not trainer.get(35):
            raise ValueError("not a merge-type vocabulary with byte fallback")
        if plain.get(2) or plain.get(4, 1) or not plain.get(5, 1):
            raise ValueError("texts would be rewritten before they are cut")
        if bad := {k for _, _, k in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"pieces of kinds {sorted(bad)} are not supported")
        self.prefix = SPACE if plain.get(3, 1) else ""
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        order = {s: r for r, s in enumerate(sorted({s for _, s, kind in pieces if kind == NORMAL}, reverse=True))}
        self.ranks = {p: order[s] for p, s, kind in pieces if kind == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        surface = trainer.get(44, " ⁇ ".encode())
        self.bytes = [
            {BYTE: lambda: bytes([int(p[3:5], 16)]), CONTROL: lambda: b"", UNKNOWN: lambda: surface}.get(kind, lambda: p.replace(SPACE, " ").encode())()
            for p, _, kind in pieces
        ]
        self.kinds = np.array([kind for _, _, kind in pieces])
        self.leads = np.array([kind == NORMAL and p.startswith(SPACE) for p, _, kind in pieces])
        several = [p for p in self.ids if len(p) > 1]
        self.stretch = self._stretches(several) if not any(SPACE in p.lstrip(SPACE) for p in several) else re.compile("(?s).+")

    @staticmethod
    def _stretches(several: list[str]) -> re.Pattern:
        """What a text is cut into: no piece crosses an edge. Letters are closed under what pieces put after them; signs
        never follow one."""
        inner = {c for p in several for c in p} - {SPACE}
        follows = {(a, b) for p in several for a, b in zip(p, p[1:])}
        letters = {c for c in inner if c.isalpha()}
        while more := {b for a, b in follows if a in letters} - letters:
            letters |= more
        group = lambda chars: "[" + re.escape("".join(sorted(chars))) + "]" if chars else "(?!)"
        return re.compile(f"{SPACE}*{group(inner - letters)}*{group(letters)}+|{SPACE}*{group(inner - letters)}+|{SPACE}+|[^{re.escape(''.join(sorted(inner)))}{SPACE}]+")

    def alone(self, symbol: str) -> list[int]:
        """The id of one symbol, or those of its bytes."""
        known = self.ids.get(symbol)
        return [known] if known is not None else [self.byte_ids[b] for b in symbol.encode()]


class Encoder:
    def __init__(self, path: str, most: int = MEMO):
        self.v = Vocabulary(path)
        self.beyond = len(self.v.kinds)
        cuts = [(p[:k], p[k:], p) for p in self.v.ids for k in range(1, len(p))]
        cuts = [(self._symbol(a), self._symbol(b), p) for a, b, p in cuts]
        cuts = [c for c in cuts if c[0] is not None and c[1] is not None]
        left, right, made = zip(*cuts) if cuts else ((), (), ())
        self.agendas = agenda.Agendas(left, right, [self.v.ids[p] for p in made], [self.v.ranks[p] for p in made], self.beyond + 0x110000)
        self.single = np.arange(self.beyond, self.beyond + 0x110000, dtype=np.int64)
        for p, i in self.v.ids.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.known = agenda.Known(self.stretches, most)

    def _symbol(self, s: str) -> int | None:
        """The number of a symbol: its id, or for a character without a piece its code point beyond all ids."""
        found = self.v.ids.get(s)
        return found if found is not None or len(s) > 1 else self.beyond + ord(s)

    def stretch(self, text: str) -> list[int]:
        """The ids of one stretch of any length, by one agenda: rank and place of each pair, those that no longer stand are passed over."""
        ranks = self.v.ranks
        symbols = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [ranks.get(a + b) for a, b in zip(symbols, symbols[1:])]
        pair.append(None)
        entries = [r << 32 | i for i, r in enumerate(pair) if r is not None]
        heapq.heapify(entries)
        while entries:
            best = heapq.heappop(entries)
            i = best & 0xFFFFFFFF
            if pair[i] != best >> 32:
                continue
            j, h = after[i], before[i]
            symbol = symbols[i] = symbols[i] + symbols[j]
            symbols[j] = ""
            pair[i] = pair[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair[i] = r = ranks.get(symbol + symbols[k])
                if r is not None:
                    heapq.heappush(entries, r << 32 | i)
            if h >= 0:
                pair[h] = r = ranks.get(symbols[h] + symbol)
                if r is not None:
                    heapq.heappush(entries, r << 32 | h)
        alone = self.v.alone
        return [x for s in symbols if s for x in alone(s)]

    def stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many stretches end to end, and how many each has: short ones together, long ones one by one."""
        sizes = np.array([len(t) for t in texts])
        short = np.flatnonzero(sizes <= agenda.SHORT).tolist()
        points = np.frombuffer("".join([texts[i] for i in short]).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, left = self.agendas.merge(self.single[points], sizes[short])
        lone = np.flatnonzero(symbols >= self.beyond)
        if len(lone):  # characters without a piece become their bytes
            raw = [[self.v.byte_ids[b] for b in chr(x).encode()] for x in (symbols[lone] - self.beyond).tolist()]
            width = np.ones(len(symbols), np.int64)
            width[lone] = [len(r) for r in raw]
            left = np.add.reduceat(width, np.cumsum(left) - left) if len(left) else left
            at = (np.cumsum(width) - width)[lone]
            symbols = np.repeat(symbols, width)
            symbols[np.repeat(at, width[lone]) + tx.spread(width[lone])] = [b for r in raw for b in r]
        if len(short) == len(texts):
            return symbols, left
        long = {i: np.array(self.stretch(texts[i]), np.int64) for i in np.flatnonzero(sizes > agenda.SHORT).tolist()}
        parts = iter(np.split(symbols, np.cumsum(left)[:-1])) if len(short) else iter(())
        each = [long[i] if i in long else next(parts) for i in range(len(texts))]
        return np.concatenate(each), np.array([len(x) for x in each])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        find, prefix = self.v.stretch.findall, self.v.prefix
        return self.known.ids([find(prefix + t.replace(" ", SPACE)) if t else [] for t in texts])


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """The encoder of a worker: the stretches that it knows serve the tasks that follow."""
    return Encoder(path)


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        codecs.register_error("wayline-bytewise", lambda e: ("�", e.start + 1))  # in the worker itself: codecs are not shipped
        self.raw = np.array([*vocabulary.bytes, b""], object)

    def decode(self, ids: pa.Array) -> list[str]:
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        none = len(self.raw) - 1
        flat = np.where((flat < 0) | (flat >= none), none, flat)
        sizes = np.array([n or 0 for n in ids.value_lengths().to_pylist()], np.int64)
        ends = np.cumsum(sizes)
        seen = np.append(self.v.kinds != CONTROL, False)[flat]
        raw = self.raw[flat].tolist()
        out = []
        for n, b in zip(sizes.tolist(), ends.tolist()):
            text = b"".join(raw[b - n : b])
            first = np.argmax(seen[b - n : b]) + b - n if n else 0
            if n and seen[first] and self.v.prefix and self.v.leads[flat[first]]:
                text = text[1:]
            out.append(text.decode("utf-8", "wayline-bytewise"))
        return out


def _texts(batch):
    return [t or "" for t in batch.column("text").to_pylist()]


def encode(docs: DataFrame, vocabulary: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, ids): the piece ids of every whole text, without begin or end; narrow.

    vocabulary: a merge-type piece file with byte fallback that every executor can open.
    """

    def run(batches):
        encoder = None
        for batch in tx.chunks(batches):
            encoder = encoder or _encoder(vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(encoder.encode(_texts(batch)))], ["doc_id", "ids"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _narrow(source, run, "ids array<int>").withColumnRenamed("doc_id", id_col)


def decode(tokens: DataFrame, vocabulary: str, *, id_col="doc_id", ids_col="ids") -> DataFrame:
    """(id, ids, decoded): the text that every list of ids stands for."""

    def run(batches):
        decoder = None
        for batch in batches:
            decoder = decoder or Decoder(Vocabulary(vocabulary))
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids = part.column("ids")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(decoder.decode(ids), pa.string())], ["doc_id", "ids", "decoded"])

    source = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return _narrow(source, run, "ids array<int>, decoded string").withColumnRenamed("doc_id", id_col)


def round_trip(docs: DataFrame, vocabulary: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, ids, decoded): encode() and decode() of every text in one task, so that ids cross to Python once."""

    def run(batches):
        encoder = None
        for batch in tx.chunks(batches, limit=1 << 20):
            if encoder is None:
                encoder = _encoder(vocabulary)
                decoder = Decoder(encoder.v)
            ids = _lists(encoder.encode(_texts(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(decoder.decode(ids), pa.string())], ["doc_id", "ids", "decoded"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _narrow(source, run, "ids array<int>, decoded string").withColumnRenamed("doc_id", id_col)


def differences(docs: DataFrame, vocabulary: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, ids, library_ids, decoded, library_decoded) of the texts that the sentencepiece library encodes or decodes otherwise."""
    import sentencepiece

    def run(batches):
        encoder = None
        for batch in tx.chunks(batches, limit=1 << 20):
            if encoder is None:
                encoder, library = _encoder(vocabulary), sentencepiece.SentencePieceProcessor(model_file=vocabulary)
                decoder = Decoder(encoder.v)
            texts = _texts(batch)
            ids = _lists(encoder.encode(texts))
            theirs = library.encode(texts, num_threads=1)
            rows = zip(batch.column("doc_id").to_pylist(), ids.to_pylist(), theirs, decoder.decode(ids), library.decode(theirs, num_threads=1))
            odd = [r for r in rows if r[1] != r[2] or r[3] != r[4]]
            kinds = [batch.schema.field("doc_id").type, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.string()]
            names = ["doc_id", "ids", "library_ids", "decoded", "library_decoded"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in odd], k) for i, k in enumerate(kinds)], names)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _narrow(source, run, "ids array<int>, library_ids array<int>, decoded string, library_decoded string").withColumnRenamed("doc_id", id_col)
