"""BPE encoding by a pair occurrence index, and decoding.

The distinct words of a chunk of texts lie in one array of symbols. An index maps each mergeable
pair to all positions where it stands; active ranks are applied in ascending order, each to all its
positions at once, and the lists of the pairs that appear left and right of a merge are extended.
Words seen before are not encoded again while memory allows.

Null and empty texts give no ids. Special strings in a text become their own ids. Texts are taken
whole; results do not depend on how they are batched. Ids outside the vocabulary, and null lists,
decode as nothing. Only the id and the column worked on are read, so further columns never clash.
"""

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .token_counts import byte_alphabet

#: Fixed value: the cutting pattern of the vocabularies with word ends.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same on ASCII text in lower case, for the quicker engine.
ASCII = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9 \t-\r]+"
MEMO = 250_000


class Vocabulary:
    """Symbols, merges and special strings of one vocabulary file with word ends; made anew in each task."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made: dict[str, int] = {}
        for r, (a, b) in enumerate(merges):
            token = a + b
            if made.get(a, -1) >= r or made.get(b, -1) >= r or token in made:
                raise ValueError("merges are not in the order in which they make tokens")
            made[token] = r
        for r, (a, b) in enumerate(merges):
            if made.get(a, -1) >= r or made.get(b, -1) >= r:
                raise ValueError("a merge uses a token made later")
        self.size = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        self.order = np.argsort(key)
        self.keys = key[self.order]
        self.parts = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        letters = {b: c for c, b in byte_alphabet().items()}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where no merge joins it."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)


class PairIndex:
    """All words of a chunk as linked symbols, and the positions of every mergeable pair."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]):
        self.v = vocabulary
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words])
        self.ends = np.cumsum(sizes)
        n = len(data)
        last = np.zeros(n, bool)
        last[self.ends - 1] = True
        self.symbol = np.where(last, vocabulary.final[data], vocabulary.inner[data])
        self.next = np.where(last, -1, np.arange(1, n + 1))
        self.prev = np.where(np.concatenate([[True], last[:-1]]), -1, np.arange(-1, n - 1))
        self.alive = np.ones(n, bool)
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._add(np.flatnonzero(~last))

    def _add(self, at: np.ndarray):
        """Put the pairs that begin at these positions in the index."""
        ranks = self.v.ranks(self.symbol[at], self.symbol[self.next[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        begins, counts = tx.runs(ranks)
        for rank, a, n in zip(ranks[begins].tolist(), begins.tolist(), counts.tolist()):
            if rank not in self.lists:
                self.lists[rank] = []
                heapq.heappush(self.active, rank)
            self.lists[rank].append(at[a : a + n])

    def merge(self):
        while self.active:
            rank = heapq.heappop(self.active)
            left, right = self.v.parts[rank]
            found = self.lists.pop(rank)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            after = self.next[at]
            good = self.alive[at] & (after >= 0) & (self.symbol[at] == left)
            at, after = at[good], after[good]
            good = self.symbol[after] == right
            at, after = at[good], after[good]
            if left == right and len(at) > 1:  # of overlapping pairs the leftmost goes first
                at = np.sort(at)
                taken, keep = -1, []
                for p, q in zip(at.tolist(), self.next[at].tolist()):
                    if p != taken:
                        keep.append(p)
                        taken = q
                at = np.array(keep)
                after = self.next[at]
            if not len(at):
                continue
            self.symbol[at] = self.v.made[rank]
            self.alive[after] = False
            beyond = self.next[after]
            self.next[at] = beyond
            inside = beyond >= 0
            self.prev[beyond[inside]] = at[inside]
            before = self.prev[at]
            self._add(np.concatenate([before[before >= 0], at[inside]]))
        return self

    def ids(self) -> list[np.ndarray]:
        left = np.cumsum(self.alive)[self.ends - 1]
        return np.split(self.symbol[self.alive].astype(np.int32), left[:-1])


class Encoder:
    def __init__(self, spec: dict):
        self.v = Vocabulary(spec)
        self.ascii, self.full, self.space = re.compile(ASCII), regex.compile(PATTERN), regex.compile(r"\s+")
        self.special = re.compile("|".join(map(re.escape, sorted(self.v.special, key=len, reverse=True)))) if self.v.special else None
        self.memo: dict[str, np.ndarray] = {}

    def cut(self, text: str) -> list[str]:
        """The words of a text in lower case; a special string is a word of its own."""
        if self.special is None or "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._plain(text[at : m.start()]) + [m[0]]
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        # lower case letter by letter: no rule for a sigma that ends a word
        return self.full.findall(self.space.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo = {}
        if not self.memo:
            self.memo = {s: np.array([i], np.int32) for s, i in self.v.special.items()}
        memo = self.memo
        new = list({w for words in cut for w in words if w not in memo})
        if new:
            memo |= zip(new, PairIndex(self.v, [w.encode() for w in new]).merge().ids())
        none = np.zeros(0, np.int32)
        return [np.concatenate([memo[w] for w in words]) if words else none for words in cut]


def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Decoder:
    """The tokens of ids, special ones too, joined as the library joins them; ids outside the vocabulary are nothing."""

    def __init__(self, spec: dict):
        known = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        self.names = np.array([known.get(i) for i in range(max(known) + 1)], object)

    def decode(self, ids: pa.Array) -> list[str]:
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        bad = (flat < 0) | (flat >= len(self.names))
        words = self.names[np.where(bad, 0, flat)]
        words[bad] = None
        sizes = np.array([n or 0 for n in ids.value_lengths().to_pylist()], np.int64)
        ends = np.cumsum(sizes)
        return [" ".join([w for w in words[b - n : b] if w is not None]) for n, b in zip(sizes.tolist(), ends.tolist())]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def _narrow(source, run, columns):
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, {columns}")


def encode(docs: DataFrame, vocabulary: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, ids): the token ids of every whole text, without begin or end tokens; narrow.

    vocabulary: a BPE file with word ends that every executor can open.
    """

    def run(batches):
        encoder = None
        for batch in tx.chunks(batches):
            encoder = encoder or Encoder(_load(vocabulary))
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _narrow(source, run, "ids array<int>").withColumnRenamed("doc_id", id_col)


def decode(tokens: DataFrame, vocabulary: str, *, id_col="doc_id", ids_col="ids") -> DataFrame:
    """(id, ids, decoded): the tokens of every list of ids, special ones too, as the library joins them."""

    def run(batches):
        decoder = None
        for batch in batches:
            decoder = decoder or Decoder(_load(vocabulary))
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids = part.column("ids")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(decoder.decode(ids), pa.string())], ["doc_id", "ids", "decoded"])

    source = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return _narrow(source, run, "ids array<int>, decoded string").withColumnRenamed("doc_id", id_col)


def round_trip(docs: DataFrame, vocabulary: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, ids, decoded): encode() and decode() of every text in one task, so that ids cross to Python once."""

    def run(batches):
        encoder = decoder = None
        for batch in tx.chunks(batches, limit=1 << 20):
            if encoder is None:
                spec = _load(vocabulary)
                encoder, decoder = Encoder(spec), Decoder(spec)
            ids = _lists(encoder.encode([t or "" for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(decoder.decode(ids), pa.string())], ["doc_id", "ids", "decoded"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _narrow(source, run, "ids array<int>, decoded string").withColumnRenamed("doc_id", id_col)
