"""Whole texts as byte arrays: Arrow batches cut into chunks of bounded size, words found and hashed by numpy."""

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words of more bytes are hashed by XXH3: a polynomial modulo 2**64 takes some long words of a regular make for each other.
LONG_WORD = 64
#: The white space of the word pattern [^\x20\x09-\x0D]+
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True

CHUNK_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def release():
    """Give memory that a task no longer uses back to the system: a worker outlives its tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def chunks(batches, column="text", limit=CHUNK_BYTES):
    """Slices of the batches with at most `limit` bytes of text each; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes) - 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    release()


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more entry: the end). Null: empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray):
    """Start and end of every word, and the index of the text that holds it. No word spans two texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~WHITE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | fresh[1:-1]
    ends[:-1] &= ~solid[1:] | fresh[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, side="right") - 1


def joined_words(data: np.ndarray, offsets: np.ndarray):
    """The texts with one space between neighbouring words and nothing else, and the bounds and owners of the words in them."""
    starts, ends, owner = word_bounds(data, offsets)
    data, keep = data.copy(), ~WHITE[data]
    gap = starts[np.diff(owner, prepend=-1) == 0] - 1
    data[gap] = 32
    keep[gap] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], place[starts], place[ends], owner


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of unsigned 64-bit values that spreads every input bit."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of byte ranges by a polynomial modulo 2**64; keeps its tables of powers."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.undo = np.ones(1, np.uint64)

    def _grow(self, n: int):
        if len(self.powers) < n:
            size = max(n, 1 << 16)
            for name, base in (("powers", self.base), ("undo", self.inverse)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Running sums from which of() reads the hash of any range."""
        self._grow(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.powers[: len(values)], out=total[1:])
        return total

    def of(self, totals: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        return mixed((totals[ends] - totals[starts]) * self.undo[starts] + (ends - starts).astype(np.uint64), seed)

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, block: int = 1 << 16) -> np.ndarray:
        """Hashes of ascending ranges, a block of them at a time, so that tables stay as small as a block."""
        out = np.empty(len(starts), np.uint64)
        for a in range(0, len(starts), block):
            s, e = starts[a : a + block], ends[a : a + block]
            part = values[s[0] : e.max()]
            out[a : a + block] = self.of(self.totals(part), s - s[0], e - s[0], seed)
        return out

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of words as byte ranges in ascending order; two that differ meet no more often than by chance, however they are made."""
        out = self.ranges(data, starts, ends)
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], self.base)
        return out


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal neighbours begins, and its length."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return at, np.diff(np.append(at, len(values)))


def spread(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of counts, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
