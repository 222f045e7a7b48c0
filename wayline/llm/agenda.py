"""Agendas of adjacent symbol pairs for many short words at once, and words encoded before.

Every word has an agenda of its pairs, best rank first, of equal ranks the leftmost. All words take
the first entry of their agenda in the same round: the pair becomes one symbol, and the pairs left
and right of it are looked up again. A word is done when its agenda is empty.
"""

from itertools import chain

import numpy as np

from . import text as tx

NONE = np.iinfo(np.int32).max
#: Symbols of a word that takes part; longer ones are the caller's.
SHORT = 64


class Agendas:
    """left, right: symbols of each pair that may merge; made: the symbol it becomes; rank: smaller goes first. n: above all symbols."""

    def __init__(self, left, right, made, rank, n: int):
        key = np.asarray(left, np.int64) * n + np.asarray(right, np.int64)
        order = np.argsort(key)
        self.n, self.keys = n, key[order]
        self.made, self.rank = np.asarray(made, np.int64)[order], np.asarray(rank, np.int32)[order]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pair, and its rank; -1 and NONE where the two never merge."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, at, -1), np.where(hit, self.rank[at], NONE)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words, end to end, after all merges, and how many each word has left."""
        starts, left = np.cumsum(sizes) - sizes, sizes.copy()
        out = symbols.astype(np.int64)
        width = 2
        while width <= SHORT:
            rows = np.flatnonzero((sizes > width // 2) & (sizes <= width) & (sizes > 1))
            for a in range(0, len(rows), 1 << 15):
                self._together(out, starts, sizes, left, rows[a : a + (1 << 15)], width)
            width *= 2
        keep = tx.spread(sizes) < np.repeat(left, sizes)
        return out[keep], left

    def _together(self, out, starts, sizes, left, rows, width):
        columns = np.arange(width)
        inside = columns < sizes[rows, None]
        s = np.where(inside, out[np.minimum(starts[rows, None] + columns, len(out) - 1)], -1)
        pair, rank = self._pairs(s[:, :-1], s[:, 1:])
        while len(rows):
            at = rank.argmin(axis=1)
            going = rank[np.arange(len(rows)), at] < NONE
            if not going.all():
                done, whole = rows[~going], s[~going]
                full = whole >= 0
                left[done] = full.sum(axis=1)
                out[(starts[done, None] + columns)[full]] = whole[full]
                rows, s, pair, rank, at = rows[going], s[going], pair[going], rank[going], at[going]
                if not len(rows):
                    return
            each = np.arange(len(rows))
            new = self.made[pair[each, at]]
            after = columns[:-1] + (columns[:-1] > at[:, None])
            last = after == width - 1
            s[:, :-1] = np.take_along_axis(s, after, 1)
            s[:, -1] = -1
            s[each, at] = new
            after[last] = width - 2
            pair, rank = np.take_along_axis(pair, after, 1), np.take_along_axis(rank, after, 1)
            pair[:, -1], rank[:, -1] = -1, NONE
            pair[each, at], rank[each, at] = self._pairs(new, s[each, at + 1])
            inner = np.flatnonzero(at > 0)
            before = at[inner] - 1
            pair[inner, before], rank[inner, before] = self._pairs(s[inner, before], new[inner])


class Known:
    """Ids of words encoded before, end to end in one array; solve(words) gives the ids of new ones and how many each has."""

    def __init__(self, solve, most: int):
        self.solve, self.most = solve, most
        self._forget()

    def _forget(self):
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.sizes = (np.zeros(0, k) for k in (np.int32, np.int64, np.int64))

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The ids of every text, given as its words in order."""
        if len(self.place) > self.most:
            self._forget()
        place = self.place
        new = list({w for words in texts for w in words if w not in place})
        if new:
            flat, sizes = self.solve(new)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            place.update(zip(new, range(len(place), len(place) + len(new))))
        words = np.fromiter(chain.from_iterable(map(place.__getitem__, t) for t in texts), np.int64)
        sizes = self.sizes[words]
        ids = self.flat[np.repeat(self.starts[words], sizes) + tx.spread(sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([len(t) for t in texts])] if texts else []
        return np.split(ids, ends[:-1]) if texts else []
