"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word's subwords are its letter n-grams, with marks at both ends, and the word itself, all hashed
into a table of embeddings. A text is the average of the embeddings of all its subwords; a linear
layer and a softmax give the languages. Table and layer are trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows: tasks count the table rows of the subwords of each
sampled text, whole, and cut parts from all over it beside, so that short texts are learned too; no
text reaches the driver. The softmax is calibrated by a temperature on rows kept out of training, and the least confidence at which a text is accepted is set there too, so that
a fixed small share of clean texts, short ones included, would be refused.

As all is linear, each distinct word is scored once and texts only add up scores, whole.

A null text, and one without a letter, is `und` with score 0 and is not accepted. Without labelled
rows every text is. Equal texts get equal answers; the id never counts. Only the id, text and label
named are read, so further columns never clash.
"""

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import scratch
from . import text as tx
from .sampling import bounded, stratified

UNKNOWN = "und"
TABLE = 1 << 16
#: How much faster the table learns than the layer above it; a word touches few of its rows.
GAIN = 100.0
MEMO = 200_000


class Subwords:
    """The words of texts and the table rows of their subwords."""

    def __init__(self, table: int = TABLE, shortest: int = 2, longest: int = 4):
        self.table, self.shortest, self.longest = table, shortest, longest
        self.ascii, self.full = re.compile(r"[a-z]+"), regex.compile(r"\p{L}+")
        self.hasher = tx.Hasher()

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        low = text.lower()
        return (self.ascii if low.isascii() else self.full).findall(low)

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all subwords of the words, one word after another, and their number for each word."""
        marked = [f"<{w}>" for w in words]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(m) for m in marked], np.int64)
        starts = np.cumsum(sizes) - sizes
        sums = self.hasher.totals(points)
        owner, found = [np.arange(len(words))], [self.hasher.of(sums, starts, starts + sizes, seed=1)]
        place = tx.spread(sizes)
        whose = np.repeat(np.arange(len(words)), sizes)
        room = np.repeat(sizes, sizes) - place
        at = np.arange(len(points))
        for n in range(self.shortest, self.longest + 1):
            here = at[room >= n]
            owner.append(whose[here])
            found.append(self.hasher.of(sums, here, here + n))
        owner, found = np.concatenate(owner), np.concatenate(found)
        order = np.argsort(owner, kind="stable")
        return (found[order] % np.uint64(self.table)).astype(np.int64), np.bincount(owner, minlength=len(words))


def _softmax(z):
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class Piece:
    """What training takes of a text besides the whole: how many parts, and of how many words at most."""

    PARTS, SHORT, LONG, TINY = 2, 40, 100, 3


def _part(words: list[str], longest: int, rng) -> list[str]:
    """Some neighbouring words from anywhere in a text."""
    n = int(min(len(words), rng.integers(1, longest + 1)))
    a = int(rng.integers(0, len(words) - n + 1))
    return words[a : a + n]


def pieces(rows: DataFrame, table: int = TABLE) -> DataFrame:
    """(key, label, parts, rows, counts, size) of (key, label, text) rows: the table rows of all subwords of the text and how often
    each occurs, packed, and those of a few parts drawn over the text by its key; the last two, a long and a tiny one, are for
    calibration. size: bytes in all, at most as many as the table has rows allow. Texts without a letter give none."""
    kind = np.min_scalar_type(table - 1)

    def cut(batches):
        cutter = Subwords(table)
        for batch in tx.chunks(batches, limit=1 << 20):
            keys, labels, out, whole, counts, sizes_ = [], [], [], [], [], []
            for key, label, text in zip(*(batch.column(c).to_pylist() for c in ("key", "label", "text"))):
                if words := cutter.words(text):
                    rng = np.random.default_rng(key & 0xFFFFFFFFFFFFFFFF)
                    sizes = [Piece.SHORT] * Piece.PARTS + [Piece.LONG, Piece.TINY]
                    out.append([cutter.rows(_part(words, n, rng))[0].astype(kind).tobytes() for n in sizes])
                    rows_, n = np.unique(cutter.rows(words)[0], return_counts=True)
                    whole.append(rows_.astype(kind).tobytes())
                    counts.append(n.astype(np.float32).tobytes())
                    sizes_.append(sum(map(len, out[-1])) + len(whole[-1]) + len(counts[-1]))
                    keys.append(key)
                    labels.append(label)
            columns = [pa.array(keys, pa.int64()), pa.array(labels, pa.string()), pa.array(out, pa.list_(pa.binary())), pa.array(whole, pa.binary()), pa.array(counts, pa.binary()), pa.array(sizes_, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "label", "parts", "rows", "counts", "size"])

    return rows.select("key", "label", "text").mapInArrow(cut, "key long, label string, parts array<binary>, rows binary, counts binary, size long")


def _means(lists, table_rows, counts=None):
    """The average of the table's rows over each list, where each counts as often as counts say; the rows, and what each adds to its average."""
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate(lists).astype(np.int64)
    share = np.concatenate(counts) if counts is not None else np.ones(len(flat))
    starts = np.cumsum(sizes) - sizes
    share = share / np.repeat(np.add.reduceat(share, starts), sizes)
    return np.add.reduceat(table_rows[flat] * share[:, None], starts, axis=0), flat, sizes, share


def train(parts: list[list[np.ndarray]], whole: list[tuple[np.ndarray, np.ndarray]], labels: list[str], *, dim=12, table=TABLE, steps=1200, rate=2.0, refused=0.001, seed=7) -> dict | None:
    """The model of labelled pieces(): scores of every table row, bias, temperature and least confidence. None without rows.

    whole: the table rows of each text and their counts. Every other step takes whole texts, the steps between parts of texts.
    """
    if not parts:
        return None
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    truth = np.searchsorted(names, labels)
    order = rng.permutation(len(parts))
    held = order[: max(1, len(parts) // 4)]
    learn = order[len(held) :] if len(parts) > 4 else order

    emb = rng.normal(0, 0.1, (table, dim))
    out, bias = rng.normal(0, 0.1, (dim, len(names))), np.zeros(len(names))
    queue = np.zeros(0, np.int64)
    for step in range(steps):
        if len(queue) < 32:
            queue = np.concatenate([queue, rng.permutation(learn)])
        part, queue = queue[:32], queue[32:]
        if step % 2:
            lists, counts = zip(*(whole[i] for i in part))
        else:
            lists, counts = [parts[i][k] for i, k in zip(part, rng.integers(0, Piece.PARTS, len(part)))], None
        mean, rows, sizes, share = _means(lists, emb, counts)
        slope = _softmax(mean @ out + bias)
        slope[np.arange(len(part)), truth[part]] -= 1
        slope /= len(part)
        pace = rate * (1 - step / steps) + 0.01
        back = slope @ out.T
        out -= pace * mean.T @ slope
        bias -= pace * slope.sum(axis=0)
        np.add.at(emb, rows, -pace * GAIN * np.repeat(back, sizes, axis=0) * share[:, None])
    scores = emb @ out

    # calibration: whole texts that training has not seen, and long and tiny parts of them
    z = [_means([whole[i][0] for i in held], scores, [whole[i][1] for i in held])[0]] + [_means([parts[i][k] for i in held], scores)[0] for k in (Piece.PARTS, Piece.PARTS + 1)]
    z = np.concatenate(z) + bias
    right = np.tile(truth[held], 3)
    heats = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), right], 1e-12)).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    least = float(min(np.quantile(_softmax(z / heat).max(axis=1), refused), 0.5))
    return {"names": names, "scores": scores.astype(np.float32), "bias": bias, "heat": heat, "least": least, "table": table}


def fit(labelled: DataFrame, *, id_col="doc_id", text_col="text", label_col="lang", quota=1500, most_rows=12_000, most_bytes=64 << 20) -> dict | None:
    """Train on about `quota` rows of each label and `most_rows` in all, drawn by a hash of id and text, and on fewer whole rows
    where what they hash to would take more than `most_bytes`.

    Tasks send the counts of table rows of each sampled text, whole, and of a few parts of it: a row
    costs the driver at most what the table and the parts take, however long its text is.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    with scratch() as keep:
        drawn = keep(pieces(stratified(rows, "label", ["doc_id", "text"], quota, most_rows)).dropDuplicates(["key", "label"]), "sample")
        sample = bounded(drawn, "key", "size", most_bytes).toArrow()
    order = sample.select(["label", "key"]).add_column(0, "at", pa.array(range(sample.num_rows))).sort_by([("label", "ascending"), ("key", "ascending")]).column("at").to_pylist()
    kind = np.min_scalar_type(TABLE - 1)
    column = lambda name: (values := sample.column(name).to_pylist()) and [values[i] for i in order]
    parts, labels = [[np.frombuffer(b, kind) for b in ps] for ps in column("parts")], column("label")
    whole = [(np.frombuffer(r, kind), np.frombuffer(n, np.float32)) for r, n in zip(column("rows"), column("counts"))]
    del sample, column
    tx.release()
    model = train(parts, whole, labels)
    del parts, whole
    tx.release()
    return model


class Scorer:
    def __init__(self, model: dict):
        self.m, self.cutter = model, Subwords(model["table"])
        self.reset()

    def reset(self):
        self.known: dict[str, int] = {}
        self.sums = np.zeros((1 << 12, len(self.m["names"])), np.float64)
        self.counts = np.zeros(1 << 12, np.int64)

    def learn(self, words: list[str]):
        rows, per_word = self.cutter.rows(words)
        ends = np.cumsum(per_word)
        base, need = len(self.known), len(self.known) + len(words)
        if need > len(self.counts):
            grown = max(need, 2 * len(self.counts))
            self.sums = np.concatenate([self.sums[:base], np.zeros((grown - base, self.sums.shape[1]))])
            self.counts = np.concatenate([self.counts[:base], np.zeros(grown - base, np.int64)])
        self.sums[base:need] = np.add.reduceat(self.m["scores"][rows].astype(np.float64), ends - per_word, axis=0)
        self.counts[base:need] = per_word
        self.known |= zip(words, range(base, need))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the labels for each text, and whether it has a letter."""
        cut = [self.cutter.words(t) for t in texts]
        if len(self.known) > MEMO:
            self.reset()
        known = self.known
        if new := list(dict.fromkeys(w for ws in cut for w in ws if w not in known)):
            self.learn(new)
        some = np.array([bool(ws) for ws in cut], bool)
        z = np.zeros((len(texts), len(self.m["names"])))
        if some.any():
            sizes = np.array([len(ws) for ws in cut])[some]
            starts = np.cumsum(sizes) - sizes
            at = np.fromiter((known[w] for ws in cut for w in ws), np.int64, int(sizes.sum()))
            z[some] = np.add.reduceat(self.sums[at], starts, axis=0) / np.add.reduceat(self.counts[at], starts)[:, None]
        return _softmax((z + self.m["bias"]) / self.m["heat"]), some


def predict(docs: DataFrame, model: dict | None, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, lang_pred, score, accepted) of every whole text; narrow. The model's table is of a fixed size and goes with the tasks."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        scorer = None
        for batch in tx.chunks(batches, limit=1 << 20):
            if model is None:
                p, some = np.zeros((batch.num_rows, 1)), np.zeros(batch.num_rows, bool)
                names, least = np.array([UNKNOWN], object), 1.0
            else:
                scorer = scorer or Scorer(model)
                p, some = scorer.score(batch.column("text").to_pylist())
                names, least = np.array(model["names"], object), model["least"]
            best = p.argmax(axis=1)
            score = np.where(some, p[np.arange(len(p)), best], 0.0)
            lang = np.where(some, names[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(some & (score >= least))], ["doc_id", "lang_pred", "score", "accepted"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("doc_id", id_col)


def accepted(docs: DataFrame, model: dict | None, *, text_col="text") -> DataFrame:
    """The documents whose language the model is sure enough of, all their columns as they were; narrow. Without a model none is."""

    def run(batches):
        scorer = Scorer(model) if model else None
        for batch in tx.chunks(batches, text_col, limit=1 << 20):
            if scorer:
                p, some = scorer.score(batch.column(text_col).to_pylist())
                yield batch.filter(pa.array(some & (p.max(axis=1) >= model["least"])))

    return docs.mapInArrow(run, docs.schema)
