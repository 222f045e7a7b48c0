"""Exact token counts at every prefix of a text, for a byte-level BPE vocabulary.

Prefix dynamic programming: in byte-level BPE the last token of a prefix's encoding decides the
rest, so a piece (what the pre-tokenizer cuts) is solved from left to right. For each prefix the
one token is found whose bytes end the prefix and which the merges keep apart from the last token
of what stands before it; its count is one more than the count there. All distinct short pieces of a
chunk of texts advance together, one prefix length a step; long ones go by themselves, in time that
grows with their length. Counts add up over pieces, so a text's
count, the longest prefix within a budget and the tokens of any prefix come without encoding again.

Null and empty texts count zero tokens. Special strings in a text count as the library's default
has them: one token each. Results do not depend on how texts are batched; equal rows give equal
counts. Only id, text and the columns asked for are read, so further columns never clash.
"""

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Fixed value: the cutting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same on ASCII text, for the quicker engine.
ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9 \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"

MEMO = 400_000
#: Pieces of more bytes are solved one by one, others together.
LONG = 200
#: Bytes of a long piece whose tokens are looked up together.
STRETCH = 1 << 14


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts by prefix for one vocabulary file; made anew in each task."""

    def __init__(self, spec: dict):
        model, alphabet = spec["model"], byte_alphabet()
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        raw = {t: bytes(alphabet[c] for c in t) for t in vocab}
        made = {a + b: r for r, (a, b) in enumerate(merges)}
        if len(made) != len(merges):
            raise ValueError("two merges make the same token: the prefix recurrence does not hold")
        # tokens by rank: single bytes first, then in the order in which merges make them
        order = sorted((t for t in vocab if len(raw[t]) == 1 or t in made), key=lambda t: made.get(t, -1))
        rank = {t: i for i, t in enumerate(order)}
        self.left, self.right = np.arange(len(order)), np.arange(len(order))
        for a, b in merges:
            t = rank[a + b]
            if max(rank[a], rank[b]) >= t:
                raise ValueError("a merge uses a token made later: the prefix recurrence does not hold")
            self.left[t], self.right[t] = rank[a], rank[b]
        pair = np.array([rank[a] * len(order) + rank[b] for a, b in merges], np.int64)
        at = np.argsort(pair)
        self.pairs, self.pair_made = pair[at], np.array([rank[a + b] for a, b in merges], np.int64)[at]
        self.n = len(order)
        self.widths = sorted({len(raw[t]) for t in order})
        self.merged: dict[int, int] = {}
        self.stand: dict[int, bool] = {}
        self.hasher = tx.Hasher()
        data = np.frombuffer(b"".join(raw[t] for t in order), np.uint8)
        ends = np.cumsum([len(raw[t]) for t in order])
        starts = ends - np.array([len(raw[t]) for t in order])
        keys = self.hasher.ranges(data, starts, ends)
        at = np.argsort(keys)
        self.keys, self.token_of = keys[at], at
        if len(np.unique(keys)) != len(keys):
            raise ValueError("hashes of two tokens collide; choose another base")

    def apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the merges leave the two tokens side by side, for each pair.

        Both tokens are taken apart from the junction, the later-made one first; if at some point
        the two neighbours there would have merged before the tokens were whole, they don't stand.
        """
        a, b = first.copy(), second.copy()
        ok = np.ones(len(a), bool)
        bound = np.full(len(a), self.n + 1)  # a merge at the junction counts if made before this
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined = (self.pairs[at] == key) & (self.pair_made[at] < bound[live])
            ok[live[joined]] = False
            live, x, y = live[~joined], x[~joined], y[~joined]
            take_left = x > y
            i, j = live[take_left], live[~take_left]
            # taking the left token apart: a junction merge wins only if made before it (ties go left)
            bound[i] = a[i]
            part = self.right[a[i]]
            atom = part == a[i]
            a[i] = part
            bound[j] = b[j] + 1
            part_j = self.left[b[j]]
            atom_j = part_j == b[j]
            b[j] = part_j
            # a single byte cannot be taken apart: go on with the other side
            stuck_i, stuck_j = i[atom], j[atom_j]
            bound[stuck_i] = b[stuck_i] + 1
            other = self.left[b[stuck_i]]
            done_i = other == b[stuck_i]
            b[stuck_i] = other
            bound[stuck_j] = a[stuck_j]
            other = self.right[a[stuck_j]]
            done_j = other == a[stuck_j]
            a[stuck_j] = other
            gone = np.concatenate([stuck_i[done_i], stuck_j[done_j]])
            if len(gone):
                keep = np.ones(len(a), bool)
                keep[gone] = False
                live = live[keep[live]]
        return ok

    def _stand(self, a: int, b: int) -> bool:
        """apart() for one pair."""
        merged, left, right, bound = self.merged, self.lefts, self.rights, self.n + 1
        while True:
            made = merged.get(a * self.n + b)
            if made is not None and made < bound:
                return False
            if a > b:
                bound, part = a, right[a]
                if part == a:
                    bound, part = b + 1, left[b]
                    if part == b:
                        return True
                    b = part
                else:
                    a = part
            else:
                bound, part = b + 1, left[b]
                if part == b:
                    bound, part = a, right[a]
                    if part == a:
                        return True
                    a = part
                else:
                    b = part

    def solve_long(self, piece: bytes) -> np.ndarray:
        """solve() for one long piece: tokens that end at any byte of a stretch are looked up together, then prefixes go one by one."""
        if not self.merged:
            self.merged = dict(zip(self.pairs.tolist(), self.pair_made.tolist()))
            self.lefts, self.rights = self.left.tolist(), self.right.tolist()
        data, n = np.frombuffer(piece, np.uint8), len(piece)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        most, stand, many = self.widths[-1], self.stand, self.n
        for a in range(0, n, STRETCH):
            b, base = min(n, a + STRETCH), max(0, a - most)
            totals = self.hasher.totals(data[base:b])
            ends, widths, tokens = [], [], []
            for width in self.widths:
                to = np.arange(max(a + 1, width), b + 1)
                if not len(to):
                    break
                key = self.hasher.of(totals, to - width - base, to - base)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == key)
                ends.append(to[hit])
                widths.append(np.full(len(hit), width))
                tokens.append(self.token_of[at[hit]])
            ends, widths, tokens = (np.concatenate(x) for x in (ends, widths, tokens))
            order = np.lexsort((-widths, ends))
            done = 0
            for end, width, token in zip(ends[order].tolist(), widths[order].tolist(), tokens[order].tolist()):
                if end == done:
                    continue
                at = end - width
                if at:
                    pair = last[at] * many + token
                    fits = stand.get(pair)
                    if fits is None:
                        fits = stand[pair] = self._stand(last[at], token)
                    if not fits:
                        continue
                last[end], count[end], done = token, count[at] + 1, end
            if len(stand) > MEMO * 4:
                stand.clear()
        return np.array(count[1:], np.int64)

    def solve(self, pieces: list[bytes]) -> list[np.ndarray]:
        """For each piece the token counts of its prefixes of 1, 2, ... bytes."""
        long = [i for i, p in enumerate(pieces) if len(p) > LONG]
        if long:
            done = {i: self.solve_long(pieces[i]) for i in long}
            rest = iter(self.solve([p for p in pieces if len(p) <= LONG]))
            return [done[i] if i in done else next(rest) for i in range(len(pieces))]
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        last = np.full(len(data), -1)
        count = np.zeros(len(data), np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        totals = self.hasher.totals(data)
        for end in range(1, int(sizes.max(initial=0)) + 1):
            active = by_size[: np.searchsorted(-sizes[by_size], -end, side="right")]
            base = starts[active]
            for width in self.widths:
                if width > end:
                    break
                at = base + end - width
                key = self.hasher.of(totals, at, at + width)
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[found] == key)
                if not len(hit):
                    continue
                token, where = self.token_of[found[hit]], at[hit]
                if width < end:
                    fits = self.apart(last[where - 1], token)
                    token, where = token[fits], where[fits]
                    count[where + width - 1] = count[where - 1] + 1
                else:
                    count[where + width - 1] = 1
                last[where + width - 1] = token
        return np.split(count, np.cumsum(sizes)[:-1])


class TextCounter:
    """Prefix counts of whole texts: pieces are solved once and remembered while memory allows."""

    def __init__(self, spec: dict):
        self.counter = PrefixCounter(spec)
        self.ascii, self.full = re.compile(ASCII), regex.compile(PATTERN)
        self.special = re.compile("|".join(map(re.escape, self.counter.special))) if self.counter.special else None
        self.memo: dict[str, np.ndarray] = {}
        self.size: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        """The pieces of a text; a special string is a piece of its own."""
        if self.special is None or not self.special.search(text):
            return (self.ascii if text.isascii() else self.full).findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.cut(text[at : m.start()]) + [m[0]]
            at = m.end()
        return out + self.cut(text[at:])

    def learn(self, pieces: set[str]):
        if len(self.memo) > MEMO:
            self.memo, self.size = {}, {}
        new = [p for p in pieces if p not in self.size]
        for p in [p for p in new if p in self.counter.special]:
            self.memo[p] = np.concatenate([np.zeros(len(p.encode()) - 1, np.int64), [1]])
        new = [p for p in new if p not in self.counter.special]
        if new:
            self.memo |= zip(new, self.counter.solve([p.encode() for p in new]))
        for p in pieces:
            self.size[p] = int(self.memo[p][-1])

    def texts(self, texts: list[str], limit: int):
        """Of each text: tokens in all, and the bytes of its longest prefix of whole characters within `limit` tokens.

        A prefix that ends inside a run of white space counts that run as far as it goes.
        """
        cut = [self.cut(t) for t in texts]
        self.learn({p for pieces in cut for p in pieces})
        size = self.size
        totals, fits = [], []
        for t, pieces in zip(texts, cut):
            each = [size[p] for p in pieces]
            totals.append(n := sum(each))
            if n <= limit:
                fits.append(len(t.encode()))
                continue
            so_far = np.cumsum(each)
            k = int(np.searchsorted(so_far, limit, side="right"))
            inside = self.memo[pieces[k]]
            raw = pieces[k].encode()
            room = limit - (int(so_far[k - 1]) if k else 0)
            good = [0, *(i + 1 for i in np.flatnonzero(inside <= room) if (i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80) and inside[i])]
            fits.append(sum(len(p.encode()) for p in pieces[:k]) + max(good))
        return totals, fits

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of the prefix of 0, 1, 2, ... bytes of the text as the pieces of the whole text cut it."""
        pieces = self.cut(text)
        self.learn(set(pieces))
        out, base = [np.zeros(1, np.int64)], 0
        for p in pieces:
            out.append(self.memo[p] + base)
            base += self.size[p]
        return np.concatenate(out)


def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col="doc_id", text_col="text", limit=1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, prefix_bytes) of every whole text; narrow, no shuffle.

    prefix_bytes: the longest prefix within `limit` tokens. vocabulary: a byte-level BPE file that
    every executor can open.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        counter = None
        for batch in tx.chunks(batches):
            counter = counter or TextCounter(_load(vocabulary))
            texts = [t or "" for t in batch.column("text").to_pylist()]
            totals, fits = counter.texts(texts, limit)
            sizes = np.diff(tx.as_bytes(batch.column("text"))[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals]), pa.array(fits, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "prefix_bytes"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    out = source.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, prefix_bytes long")
    return out.withColumnRenamed("doc_id", id_col)


def prefix_counts(docs: DataFrame, vocabulary: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, counts): counts[i] is the number of tokens of the text's first i bytes, for every i; null texts give [0]."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        counter = None
        for batch in tx.chunks(batches):
            counter = counter or TextCounter(_load(vocabulary))
            counts = [counter.prefix_counts(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.tolist() for c in counts], pa.list_(pa.int32()))], ["doc_id", "counts"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, counts array<int>").withColumnRenamed("doc_id", id_col)
