"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. The binary Golay code is
perfect: every 23-bit value lies within 3 bits of one codeword. A value's keys are the indices of
all codewords within 4 bits (one, or six where the nearest is 3 away), and two values that differ in
at most two bits always have a key in common. Of two errors over three segments at least one segment
has none, so fingerprints link through (clean segment, key of the next segment), and every candidate
is verified on all 64 bits.

Equal fingerprints are grouped first. A key shared by more than `crowd` fingerprints is not paired:
its members are linked through the values one bit away from them, which two fingerprints share
exactly if they differ in at most two bits; that finds the same classes with a bounded number of
rows for each member.

Null and empty texts have no words and the fingerprint zero, and link like any other. Texts are
taken whole. Repeated rows are members of one class; ties fall to the smallest id.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..storage import discard, materialise, scratch
from . import text as tx

#: Where the three segments begin and how wide they are.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: a generator polynomial of the binary Golay code.
GENERATOR = 0b110001110101
CROWD = 48


class Golay:
    """Indices of the codewords near 23-bit values."""

    def __init__(self):
        self.parity = [self._remainder(1 << i) for i in range(23)]
        self.error = np.zeros(2048, np.int64)
        bits = [1 << i for i in range(23)]
        for i in range(23):
            for j in range(i, 23):
                for k in range(j, 23):
                    e = bits[i] | bits[j] | bits[k]
                    self.error[self._remainder(e)] = e
        light = np.arange(4096) << 11
        light = light | self._syndrome(light)
        seven = light[np.bitwise_count(light) == 7]
        self.beyond = np.full((2048, 5), -1, np.int64)
        for s in np.flatnonzero(np.bitwise_count(self.error) == 3):
            self.beyond[s] = seven[(seven & self.error[s]) == self.error[s]]

    @staticmethod
    def _remainder(value: int) -> int:
        for shift in range(value.bit_length() - 12, -1, -1):
            if value >> (shift + 11) & 1:
                value ^= GENERATOR << shift
        return value

    def _syndrome(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        for i, p in enumerate(self.parity):
            out ^= np.where(values >> i & 1, p, 0)
        return out

    def keys(self, values: np.ndarray) -> np.ndarray:
        """Six columns: indices of all codewords within 4 bits of each value, -1 where there are fewer."""
        s = self._syndrome(values)
        nearest = values ^ self.error[s]
        more = self.beyond[s]
        return np.column_stack([nearest >> 11, np.where(more >= 0, (nearest[:, None] ^ more) >> 11, -1)])


def fingerprints(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=3) -> DataFrame:
    """(id, fp): the 64-bit SimHash of word shingles of every whole text, as a signed long; narrow."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in tx.chunks(batches):
            data, offsets = tx.as_bytes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text_fingerprints(data, offsets, shingle).view(np.int64))], ["doc_id", "fp"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, fp long").withColumnRenamed("doc_id", id_col)


def shingle_hashes(data, offsets, shingle):
    """XXH64 (seed 42) of every word shingle of lower-cased texts, and the index of the text of each."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    data, starts, ends, owner = tx.joined_words(data, offsets)
    raw = data.tobytes()
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first = np.repeat(np.cumsum(counts) - counts, n) + tx.spread(n)
    final = np.repeat(np.cumsum(counts) - 1, n)
    last = np.minimum(first + shingle - 1, final)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[a:b], 42) for a, b in zip(starts[first].tolist(), ends[last].tolist())], np.uint64)
    return hashes, np.repeat(np.arange(len(n)), n), n


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of `counts` hashes: the bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    ends = np.cumsum(counts)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    step = 1 << 17
    sums = np.zeros((len(counts), 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for a in range(0, int(ends[-1]), step):
        part, own = hashes[a : a + step], owner[a : a + step]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64)
        at, _ = tx.runs(own)
        sums[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    return ((sums * 2 > counts[:, None]) * weights).sum(axis=1, dtype=np.uint64)


def text_fingerprints(data, offsets, shingle):
    hashes, _, counts = shingle_hashes(data, offsets, shingle)
    return majority(hashes, counts)


def golay_keys(prints: DataFrame) -> DataFrame:
    """(key, fp, node): the keys of every row of (fp, node); at most eighteen each."""

    def run(batches):
        code = Golay()
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            rows, keys = [], []
            parts = [(fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
            for i, clean in enumerate(parts):
                near = code.keys(parts[(i + 1) % 3])
                r, c = np.nonzero(near >= 0)
                rows.append(r)
                keys.append(near[r, c] | clean[r] << 12 | i << 34)
            at = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column("fp").take(pa.array(at)), batch.column("node").take(pa.array(at))], ["key", "fp", "node"])

    return prints.mapInArrow(run, "key long, fp long, node long")


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(src, dst) links between nodes of distinct fingerprints: enough for every class linked at two bits or fewer."""
    keyed = golay_keys(prints)
    sizes = keyed.groupBy("key").count().where("count > 1")
    shared = keyed.join(sizes, "key")
    few = shared.where(F.col("count") <= crowd).select("key", "fp", "node")
    other = few.select("key", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    pairs = few.join(other, "key").where("fp < fp2 AND bit_count(fp ^ fp2) <= 2").select(F.col("node").alias("src"), F.col("node2").alias("dst"))
    many = shared.where(F.col("count") > crowd).select("fp", "node").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = many.select("node", F.explode(flips).alias("flip"), "fp").select("node", F.expr("fp ^ flip").alias("middle"))
    centre = around.groupBy("middle").agg(F.min("node").alias("dst"), F.max("node").alias("top")).where("dst <> top").select("middle", "dst")
    stars = around.join(centre, "middle").where("node <> dst").select(F.col("node").alias("src"), "dst")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=3) -> DataFrame:
    """(id, fp, component_id) of every document: fingerprints link at two differing bits or fewer; component_id is the
    smallest id that links reach, the document's own included. Ids are longs; a null id takes no part."""
    with scratch() as keep:
        prints = keep(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col=id_col, text_col=text_col, shingle=shingle), "prints")
        nodes = keep(prints.groupBy("fp").agg(F.min(id_col).alias("node")), "nodes")
        found = components(links(nodes))
        named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
        out = materialise(prints.join(named, "fp").select(id_col, "fp", "component_id"), "classes")
        discard(found)
        return out


# Near duplicates by the Jaccard similarity of their word shingles.
#
# Documents as similar as that still differ in some tenths of a narrow fingerprint of shingles, so
# Golay keys come from a wide fingerprint of words (each weighing the root of its count). They find
# most pairs, not all. Prefixes find all: with the shingles of every text in one order, rarest first,
# two sets as similar as asked have a shingle in common among the first n - ceil(similarity n) + 1 of
# each, whatever the order is.

SEEDS = 3
WIDE = 6  # segments of 23 bits
SKETCH = 8  # longs: the parity of the shingles that fall on each of 512 bits
FINE = 64 * SKETCH  # sets of more shingles have a finer sketch too, of a bit or two for each shingle
SLICES = 4  # parts of the prefix keys that are shuffled one after another
PLACES, MOST_PLACES = 1 << 24, 1 << 27  # bits of the filter for texts that a comparison needs
SAMPLE = 20_000  # texts, and a sixteenth of all at least, whose shingles tell the common ones, which stand last in the order
SHARE = 1 / 16
COMMON = 200_000  # of them at most
LEAST = 3  # texts of the sample that a common shingle occurs in


def word_segments(data, starts, ends, owner, texts, hasher) -> np.ndarray:
    """The wide fingerprint of each text, as 23-bit segments."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    hashes = hasher.words(low, starts, ends)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, np.int64)
    weight = np.sqrt(np.diff(np.append(at, len(h)))).astype(np.float32)
    h, o = h[at], o[at]
    sums = np.zeros((texts, 64 * SEEDS), np.float32)
    mean = np.bincount(o, weights=weight, minlength=texts) / 2
    for a in range(0, len(h), 1 << 13):
        part, own, w = h[a : a + (1 << 13)], o[a : a + (1 << 13)], weight[a : a + (1 << 13)]
        bits = np.unpackbits(np.column_stack([tx.mixed(part, s) for s in range(SEEDS)]).view(np.uint8), axis=1).astype(np.float32)
        for b, n in zip(*tx.runs(own)):
            sums[own[b]] += w[b : b + n] @ bits[b : b + n]
    set_bits = (sums[:, : 23 * WIDE] > mean[:, None]).reshape(texts, WIDE, 23)
    return (set_bits * (1 << np.arange(23))).sum(axis=2).astype(np.int32)


def shingle_sets(data, starts, ends, owner, texts, shingle, hasher, grams) -> list[np.ndarray]:
    """The distinct word shingles of each lower-cased text, as sorted hashes; shorter texts are one shingle."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    words = hasher.words(low, starts, ends)
    counts = np.bincount(owner, minlength=texts)
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    base = np.cumsum(counts) - counts
    first = np.repeat(base, n) + tx.spread(n)
    last = np.minimum(first + shingle, np.repeat(base + counts, n))
    hashes = grams.of(grams.totals(words), first, last)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(n)[:-1])] if texts else []


def _read(batches, limit=tx.CHUNK_BYTES >> 2):
    hasher, grams = tx.Hasher(), tx.Hasher(0x8CB92BA72F3D8DD7)
    for batch in tx.chunks(batches, limit=limit):
        yield batch, hasher, grams, tx.joined_words(*tx.as_bytes(batch.column("text")))


def _sketch(hashes):
    """The parity of a set's hashes on each of 64 * SKETCH bits: two sets differ in as many elements as their sketches do in bits, or more."""
    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _fine(hashes):
    """The same parity on as many bits as there are hashes, or up to twice as many; null for sets that the short sketch serves."""
    if len(hashes) <= FINE:
        return None
    bits = 1 << (len(hashes) - 1).bit_length()
    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """In how many elements, at least, two sets with these fine sketches differ; the longer sketch is folded to the other's length."""
    x, y = (np.frombuffer(s, np.uint8) for s in sorted((a, b), key=len))
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _outlines(source, shingle):
    """(doc_id, d1, d2, size, sketch, fine, segments): a digest, the number and sketches of each text's shingles, and its wide fingerprint."""

    def run(batches):
        for batch, hasher, grams, (data, starts, ends, owner) in _read(batches):
            sets = shingle_sets(data, starts, ends, owner, batch.num_rows, shingle, hasher, grams)
            digests = np.array([[xxhash.xxh3_64_intdigest(s.tobytes(), seed) for seed in (1, 2)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            segments = word_segments(data, starts, ends, owner, batch.num_rows, hasher)
            sketches = pa.array([_sketch(s) for s in sets], pa.list_(pa.int64()))
            fine = pa.array([_fine(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(s) for s in sets], pa.int32()), sketches, fine, pa.array([s.tobytes() for s in segments], pa.binary())],
                ["doc_id", "d1", "d2", "size", "sketch", "fine", "segments"],
            )

    return source.mapInArrow(run, "doc_id long, d1 long, d2 long, size int, sketch array<long>, fine binary, segments binary")


def _common(source, shingle, keep):
    """Hashes, sorted, and counts of the commonest shingles in a sample of texts. It only sets the order of the prefixes.

    The sample grows with the texts, so that a key left in the prefixes is shared by no more of them in a larger table.
    """
    share = min(1.0, max(SHARE, SAMPLE / max(1, source.count())))
    drawn = source.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("common")), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches):
        for batch, hasher, grams, (data, starts, ends, owner) in _read(batches):
            sets = shingle_sets(data, starts, ends, owner, batch.num_rows, shingle, hasher, grams)
            hashes, counts = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["gram", "n"])

    counts = drawn.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    found = keep(counts.orderBy(F.desc("n"), "gram").limit(COMMON), "common").toArrow()
    hashes = found.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column("n").to_numpy()[order]


def _prefixes(source, shingle, similarity, common):
    """(node, keys): the shingles of every text's prefix in order, packed: eight bytes each, where the text itself takes several times as many."""
    hashes, counts = common

    def run(batches):
        for batch, hasher, grams, (data, starts, ends, owner) in _read(batches):
            firsts = []
            for s in shingle_sets(data, starts, ends, owner, batch.num_rows, shingle, hasher, grams):
                often = np.zeros(len(s), np.int64)
                if len(hashes):
                    place = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                    often = np.where(hashes[place] == s, counts[place], 0)
                n = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1 if len(s) else 0
                firsts.append(s[np.lexsort((s, often))[:n]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(firsts, pa.binary())], ["node", "keys"])

    return source.mapInArrow(run, "node long, keys binary")


def _unpacked(prefixes, part):
    """(key, node, at): one of the SLICES of the prefix keys, and how many of the node's stand before each."""

    def run(batches):
        for batch in tx.chunks(batches, column="keys", limit=1 << 20):
            packed = batch.column("keys").to_pylist()
            sizes = np.array([len(p) // 8 for p in packed], np.int64)
            keys = np.frombuffer(b"".join(packed), np.uint64)
            mine = np.flatnonzero((keys >> np.uint64(9)) % np.uint64(SLICES) == part)
            nodes = np.repeat(batch.column("node").to_numpy(), sizes)[mine]
            yield pa.RecordBatch.from_arrays([pa.array(keys[mine].view(np.int64)), pa.array(nodes), pa.array(tx.spread(sizes)[mine].astype(np.int32))], ["key", "node", "at"])

    return prefixes.mapInArrow(run, "key long, node long, at int")


def _wide_keys(nodes):
    """(key, node): a clean segment and the Golay keys of the next one, for every segment."""

    def run(batches):
        code = Golay()
        for batch in batches:
            parts = np.frombuffer(b"".join(batch.column("segments").to_pylist()), np.int32).reshape(-1, WIDE).astype(np.int64)
            for i in range(WIDE):
                near = code.keys(parts[:, (i + 1) % WIDE])
                r, c = np.nonzero(near >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(near[r, c] | parts[r, i] << 12 | i << 35), batch.column("node").take(pa.array(r))], ["key", "node"])

    return nodes.mapInArrow(run, "key long, node long")


def _shared_keys(slices, keep):
    """The rows (key, node, ...) whose key two nodes or more share, with a weight: a node weighs as much as it shares over all its keys.

    slices: tables that have no key in common; only one of them is on its way at a time.
    """
    parts = []
    for keyed in slices:
        shared = keep(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key", "n"), "keys")
        parts.append(keep(keyed.join(shared, "key"), "members"))
        discard(shared)
    members = parts[0]
    for part in parts[1:]:
        members = members.union(part)
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = keep(members.drop("n").join(weights, "node"), "members")
    for part in parts:
        discard(part)
    return weighed


def _with_hub(members):
    """Each member of a key with the key's heaviest node: the text that the others of a family were made from shares most."""
    hub = members.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("h")).select("key", (-F.col("h.minus")).alias("hub"))
    pairs = members.join(hub, "key").where("node <> hub")
    return pairs.select(F.least("node", "hub").alias("src"), F.greatest("node", "hub").alias("dst"))


def _split(members, found, keep):
    """The members of keys that hold more than one component, with the component, the commonest one of the key and the key's size."""
    placed = members.join(found, "node", "left").select(*members.columns, F.coalesce("component", "node").alias("component"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("held"), F.max(F.struct("n", "component")).getField("component").alias("main")).where("parts > 1")
    return keep(placed.join(mixed.select("key", "held", "main"), "key"), "split")


def _hub_pairs(split, crowd):
    """In crowded keys, members against the heaviest one, and those outside the commonest component against the heaviest of them."""
    many = split.where(F.col("held") > crowd)
    return _with_hub(many).union(_with_hub(many.where("component <> main"))).distinct()


def _all_pairs(split, nodes, similarity):
    """Every pair that shares a key and is not joined, unless sizes, places in the prefixes or sketches rule it out for certain.

    Members of a key's commonest component never meet each other, so one large family costs a row for each that is not in it.
    """
    rows = split.join(nodes.select("node", "size", "sketch"), "node")
    one = rows.where("component <> main").select("key", "main", *(F.col(c).alias(f"{c}1") for c in ("node", "component", "at", "size", "sketch")))
    two = rows.select("key", *(F.col(c).alias(f"{c}2") for c in ("node", "component", "at", "size", "sketch")))
    least = f"{similarity / (1 + similarity)!r}D * (size1 + size2) - 1e-6D"
    apart = "component1 <> component2 AND (component2 = main OR node1 < node2)"
    pairs = one.join(two, "key").where(f"{apart} AND least(size1 - at1, size2 - at2) >= {least} AND {_alike(similarity)}")
    return pairs.select(F.least("node1", "node2").alias("src"), F.greatest("node1", "node2").alias("dst")).distinct()


def _alike(similarity):
    """Whether sizes and sketches leave room for the similarity asked: never false for a pair that has it."""
    bits = " + ".join(f"bit_count(sketch1[{i}] ^ sketch2[{i}])" for i in range(SKETCH))
    sizes = f"least(size1, size2) >= {similarity!r}D * greatest(size1, size2) - 1e-6D"
    return f"{sizes} AND {bits} <= {(1 - similarity) / (1 + similarity)!r}D * (size1 + size2) + 1e-6D"


def _near(nodes, pairs, similarity):
    """The pairs worth an exact comparison."""
    side = nodes.select(F.col("node").alias("src"), F.col("size").alias("size1"), F.col("sketch").alias("sketch1"), F.col("fine").alias("fine1"))
    other = nodes.select(F.col("node").alias("dst"), F.col("size").alias("size2"), F.col("sketch").alias("sketch2"), F.col("fine").alias("fine2"))

    def run(batches):
        for batch in batches:
            most = (1 - similarity) / (1 + similarity) * (batch.column("size1").to_numpy() + batch.column("size2").to_numpy()) + 1e-6
            fine = zip(batch.column("fine1").to_pylist(), batch.column("fine2").to_pylist(), most.tolist())
            good = [a is None or b is None or _apart(a, b) <= m for a, b, m in fine]
            yield batch.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    alike = pairs.join(side, "src").join(other, "dst").where(_alike(similarity))
    return alike.select("src", "dst", F.col("size1").cast("long"), F.col("size2").cast("long"), "fine1", "fine2").mapInArrow(run, "src long, dst long")


def likely(source, wanted, number=0):
    """The rows of source whose doc_id is wanted, and a few others. A filter, all that is broadcast, keeps most others out of a shuffle.

    It has PLACES bits, or for a number of wanted rows that is known 16 bits a row, and MOST_PLACES at most.
    """
    places = min(max(PLACES, 1 << (16 * number - 1).bit_length()), MOST_PLACES) if number else PLACES

    def word_and_bit(ids):
        place = F.pmod(F.xxhash64("doc_id"), F.lit(places))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
        return ids.withColumns({"_word": F.shiftright(place, 6), "_bit": bit})

    words = word_and_bit(wanted).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return word_and_bit(source).join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*source.columns)


def _texts_of(source, wanted):
    """The rows of source whose doc_id is wanted."""
    return likely(source, wanted).join(wanted, "doc_id", "left_semi")


def _gram_sets(source, pairs, shingle):
    """(doc_id, grams): the shingles of every text in a pair."""
    wanted = pairs.select(F.col("src").alias("doc_id")).union(pairs.select(F.col("dst").alias("doc_id"))).distinct()

    def cut(batches):
        for batch, hasher, grams, (data, starts, ends, owner) in _read(batches):
            sets = shingle_sets(data, starts, ends, owner, batch.num_rows, shingle, hasher, grams)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "grams"])

    return _texts_of(source, wanted).mapInArrow(cut, "doc_id long, grams binary").dropDuplicates(["doc_id"])


def _verified(pairs, sets, similarity):
    """The pairs whose shingles are as similar as asked, compared exactly."""

    def compare(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                good = []
                for i, (a, b) in enumerate(zip(part.column("g1").to_pylist(), part.column("g2").to_pylist())):
                    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= similarity * (len(x) + len(y) - both):
                        good.append(i)
                yield part.select(["src", "dst"]).take(pa.array(good, pa.int64()))

    one = sets.select(F.col("doc_id").alias("src"), F.col("grams").alias("g1"))
    two = sets.select(F.col("doc_id").alias("dst"), F.col("grams").alias("g2"))
    return pairs.join(one, "src").join(two, "dst").mapInArrow(compare, "src long, dst long")


def similar_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=5, similarity=0.8, crowd=CROWD) -> DataFrame:
    """(id, component_id) of every document: those whose sets of word shingles are as similar as asked are linked.

    Documents of equal shingles are one node, so exact copies cost nothing further. Every link is
    verified on the whole shingle sets. Members of a Golay key are compared with the one that shares
    most, which joins most of a family; then members of a prefix key that this has not joined, until
    none are left, so no pair is missed. `crowd` only sets from which size on a prefix key is first
    compared with its heaviest members. Documents without words are copies of each other.
    """
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch() as keep:
        outlines = keep(_outlines(source, shingle), "outlines")
        columns = [F.min_by(c, "doc_id").alias(c) for c in ("size", "sketch", "fine", "segments")]
        nodes = keep(outlines.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), *columns), "nodes")

        def joined(links, pairs):
            pairs = keep(_near(nodes, pairs, similarity), "pairs")
            sets = keep(_gram_sets(source, pairs, shingle), "grams")
            more = _verified(pairs, sets, similarity)
            links = keep(links.union(more) if links else more, "similar")
            discard(sets)
            return links, keep(components(links), "components")

        wide = _shared_keys([_wide_keys(nodes)], keep)
        links, found = joined(None, _with_hub(wide).distinct())
        discard(wide)
        prefixes = _prefixes(source, shingle, similarity, _common(source, shingle, keep))
        prefixes = keep(prefixes.join(nodes.select("node"), "node", "left_semi"), "prefixes")
        members = _shared_keys([_unpacked(prefixes, i) for i in range(SLICES)], keep)
        discard(prefixes)
        split = _split(members, found, keep)
        links, found = joined(links, _hub_pairs(split, crowd))
        discard(split)
        split = _split(members, found, keep)
        discard(members)
        links, found = joined(links, _all_pairs(split, nodes, similarity))
        named = nodes.join(found, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component_id"))
        return materialise(outlines.join(named, ["d1", "d2"]).select(F.col("doc_id").alias(id_col), "component_id"), "classes")


def one_of_each(docs: DataFrame, *, id_col="doc_id", **options) -> DataFrame:
    """The documents with the smallest id of their class, all their columns as they were. A document whose id is null stays."""
    spare = similar_documents(docs, id_col=id_col, **options).where(f"{id_col} <> component_id").select(F.col(id_col).alias("_spare"))
    return docs.join(spare, F.col(id_col).cast("long") == F.col("_spare"), "left_anti")
