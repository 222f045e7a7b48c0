"""Toxicity by a convolutional text classifier trained in numpy.

Words are hashed into a table of embeddings (the word itself, and its first letters, whose
embeddings add up). The first dimension of the embeddings starts as each row's log odds between
toxic and clean training texts, with one filter of width one that reads it, and the others at
random; stochastic gradient descent then trains all of them. Filters of several widths slide over the whole text, the largest response of
each is kept (max pooling) and a logistic layer weighs them. Rows kept out of training set a
temperature, the threshold that serves all texts, and one threshold for each language that has
enough rows; scores are shifted so that the common threshold stands at 0.7, and a language's own
threshold is given beside them. The language never enters a score.

Null and empty texts score what no word at all scores. Without labels of both kinds every text
scores 0. Equal texts get equal scores. Only the id, text and columns named are read, so further
columns never clash.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import scratch
from . import text as tx
from .simhash import likely

TABLE = 1 << 16
WIDTHS = (1, 2, 3)
CUT = 0.7
PREFIX = 5
MEMO = 200_000
PART_ROWS, PART_WORDS = 5_000, 5_000_000  # that are taught together; tables of more rows or words are taught in parts
RARE = 100  # rows of each label that a part has at least, about
STEP = 1 / 1024  # responses of rows kept out of training are counted on this grid


class Words:
    """Texts as rows of the embedding table: for each word its own row and that of its first letters."""

    def __init__(self, table: int = TABLE):
        self.table, self.pattern, self.hasher = table, re.compile(r"[^\W_]+"), tx.Hasher()
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, 2), np.int64)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text as numbers of known words."""
        if len(self.known) > MEMO:
            self.known = {}
        cut = [self.pattern.findall(t.lower()) if t else [] for t in texts]
        known = self.known
        if new := list(dict.fromkeys(w for ws in cut for w in ws if w not in known)):
            self._learn(new)
        return [np.fromiter((known[w] for w in ws), np.int64, len(ws)) for ws in cut]

    def _learn(self, words):
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        sums = self.hasher.totals(points)
        whole = self.hasher.of(sums, starts, starts + sizes, seed=1)
        front = self.hasher.of(sums, starts, starts + np.minimum(sizes, PREFIX), seed=2)
        base, need = len(self.known), len(self.known) + len(words)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows[:base], np.zeros((max(need, 2 * len(self.rows)) - base, 2), np.int64)])
        self.rows[base:need] = np.column_stack([whole, front]) % np.uint64(self.table)
        self.known |= zip(words, range(base, need))


def _pooled(parts, sizes, width, bias):
    """The largest response of each filter over each text, and where it is; parts[k] holds every word's share as k-th word of a window.

    Texts shorter than the window are filled up with words that answer nothing; a text without words gives the bias alone.
    """
    n, filters = parts[0].shape
    total = np.zeros((n, filters))
    starts = np.cumsum(sizes) - sizes
    room = np.repeat(sizes, sizes) - tx.spread(sizes)
    for k, part in enumerate(parts):
        total[: n - k] += np.where((room > k)[: n - k, None], part[k:], 0)
    # windows that begin late hold fewer words; they count only in texts shorter than the window
    late = (room < width) & (np.repeat(sizes, sizes) >= width)
    total[late] = -np.inf
    best = np.tile(bias, (len(sizes), 1)).astype(float)
    full = np.flatnonzero(sizes)
    if len(full):
        best[full] += np.maximum.reduceat(total, starts[full], axis=0)
    return best, total


def train(ids: list[np.ndarray], labels, langs, *, dim=8, filters=6, table=TABLE, steps=900, batch=48, rate=0.02, seed=11) -> dict | None:
    """The model of labelled texts (1: toxic), given as the two table rows of each of their words. None unless there are rows of both labels."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, learn = order[: len(y) // 4], order[len(y) // 4 :]
    if len({*y[learn]}) < 2 or len({*y[held]}) < 2:
        held = learn = order
    kinds = [learn[y[learn] == v] for v in (0, 1)]
    p = beginning(leaning([ids[i] for i in learn], y[learn], table), dim, filters, rng)
    draws = ([rng.choice(k, batch // 2) for k in kinds] for _ in range(steps))
    p = descend(p, ids, y, draws, rate, filters)
    model = {"table": table, "shift": 0.0, "heat": 1.0, "langs": {}} | p
    model["emb"] = p["emb"].astype(np.float32)

    truth, raw = y[held], raw_responses(model, [ids[i] for i in held])
    heats = np.geomspace(0.2, 20, 40)
    loss = [np.mean(np.logaddexp(0, np.where(truth == 1, -raw, raw) / t)) for t in heats]
    lang_of = np.array([langs[i] or "" for i in held])
    return calibrated(model, float(heats[int(np.argmin(loss))]), raw, np.ones(len(raw)), truth, lang_of)


def beginning(lean, dim, filters, rng) -> dict:
    """The weights before training."""
    p = {"emb": rng.normal(0, 0.1, (len(lean), dim)), "out": rng.normal(0, 0.3, len(WIDTHS) * filters), "bias": np.zeros(1)}
    for w in WIDTHS:
        p[f"f{w}"], p[f"b{w}"] = rng.normal(0, 0.5 / w, (w, dim, filters)), np.zeros(filters)
    p["emb"][:, 0] = lean
    p["f1"][0, 0, 0], p["f1"][0, 1:, 0], p["out"][0] = 1.0, 0.0, 1.0
    return p


def descend(p, ids, y, draws, rate, filters) -> dict:
    """The weights after a step for each draw: lists of row numbers, clean and toxic ones."""
    dense = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items() if k != "emb"}
    seen = np.zeros(len(p["emb"]))
    for step, drawn in enumerate(draws, 1):
        part = np.concatenate(drawn)
        lists = [ids[i] for i in part]  # whole: a toxic text's reason may stand anywhere, and the largest response of a clean one too
        sizes = np.array([len(x) for x in lists], np.int64)
        rows = np.concatenate(lists).astype(np.int64)
        x = p["emb"][rows].sum(axis=1)
        starts, grads, hidden, peaks = np.cumsum(sizes) - sizes, {}, [], []
        for w in WIDTHS:
            best, total = _pooled([x @ p[f"f{w}"][k] for k in range(w)], sizes, w, p[f"b{w}"])
            peaks.append([s + total[s : s + n].argmax(axis=0) if n else None for s, n in zip(starts, sizes)])
            hidden.append(best)
        h = np.concatenate(hidden, axis=1)
        active = np.maximum(h, 0)
        slope = (1 / (1 + np.exp(-np.clip(active @ p["out"] + p["bias"], -30, 30))) - y[part]) / len(part)
        grads["out"], grads["bias"] = active.T @ slope + 1e-4 * p["out"], slope.sum(keepdims=True)
        back = np.outer(slope, p["out"]) * (h > 0)
        dx_at, dx = [], []
        for j, w in enumerate(WIDTHS):
            g = back[:, j * filters : (j + 1) * filters]
            grads[f"b{w}"], grads[f"f{w}"] = g.sum(axis=0), np.zeros_like(p[f"f{w}"])
            for t, (s, n) in enumerate(zip(starts, sizes)):
                if not n or not g[t].any():
                    continue
                for k in range(w):
                    at = peaks[j][t] + k
                    inside = at < s + n
                    at, gk = at[inside], g[t][inside]
                    grads[f"f{w}"][k][:, inside] += x[at].T * gk
                    dx_at.append(at)
                    dx.append(p[f"f{w}"][k][:, inside].T * gk[:, None])
        for k, v in grads.items():  # Adam on the small layers
            m, s = dense[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            p[k] = p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        if dx_at:  # AdaGrad by row on the table
            at, d = np.concatenate(dx_at), np.concatenate(dx)
            for c in (0, 1):
                r = rows[at, c]
                np.add.at(seen, r, (d * d).mean(axis=1))
                np.add.at(p["emb"], r, -4 * rate * d / (np.sqrt(seen[r])[:, None] + 1e-6))
    return p


def raw_responses(model, lists) -> np.ndarray:
    """The logit of each text before calibration."""
    maps = filter_maps(model)
    return np.array([responses(model, model["emb"][x.astype(np.int64)].astype(np.float64).sum(axis=1) @ maps, np.array([len(x)]))[0] for x in lists])


def calibrated(model, heat, raw, n, hits, lang_of) -> dict:
    """The model with its temperature and thresholds; n rows, hits of them toxic, have the response raw and the language lang_of."""
    common = _threshold(raw, hits, n)
    gap = float(np.log(CUT / (1 - CUT)))
    model |= {"heat": heat, "shift": gap - common / heat}
    for lang in sorted(set(lang_of.tolist()) - {""}):
        mine = lang_of == lang
        if n[mine].sum() >= 30 and 5 <= hits[mine].sum() < n[mine].sum():
            model["langs"][lang] = float(_sigmoid(_threshold(raw[mine], hits[mine], n[mine]) / heat + model["shift"]))
    return model


def leaning(lists, y, table) -> np.ndarray:
    """How much oftener each table row occurs in toxic texts than in clean ones, as log odds shrunk toward zero."""
    return odds(occurrences(lists, y, table), len(y) - y.sum(), y.sum())


def occurrences(lists, y, table) -> np.ndarray:
    """The number of clean and of toxic texts that hold each table row."""
    seen = np.zeros((2, table))
    for x, label in zip(lists, y):
        seen[int(label), np.unique(x)] += 1
    return seen


def odds(seen, n_clean, n_toxic) -> np.ndarray:
    clean, toxic = seen
    ratio = np.log((toxic + 0.5) / (clean + 0.5)) - np.log((n_toxic + 1) / (n_clean + 1))
    return np.clip(ratio, -1, 6) * (toxic + clean) / (toxic + clean + 4) / 2


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _threshold(raw: np.ndarray, truth: np.ndarray, n: np.ndarray) -> float:
    """The cut with the best balance of precision and recall; the middle of the gap that gives it."""
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(truth[order])
    f = 2 * hits / (np.cumsum(n[order]) + truth.sum())
    values = raw[order]
    last = np.append(values[1:] != values[:-1], True)  # equal scores stay together
    k = int(np.argmax(np.where(last, f, -1)))
    return float((values[k] + values[min(k + 1, len(values) - 1)]) / 2)


def packed(texts: DataFrame, table: int = TABLE) -> DataFrame:
    """(key, label, lang, words, rows) of (doc_id, label, lang, text): the table rows of every word of each whole text, packed. Repeated rows give one."""
    kind = np.min_scalar_type(table - 1)

    def run(batches):
        words = Words(table)
        for batch in tx.chunks(batches, limit=1 << 19):
            ids = words.ids(batch.column("text").to_pylist())
            out = [words.rows[i].astype(kind).tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "label", "lang")), pa.array([len(i) for i in ids], pa.int64()), pa.array(out, pa.binary())], ["key", "label", "lang", "words", "rows"]
            )

    keyed = texts.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "text", "label"))
    rows = keyed.dropDuplicates(["doc_id", "key", "label"])  # texts that were joined by doc_id are not moved again
    return rows.select("key", "label", "lang", "text").mapInArrow(run, "key long, label int, lang string, words long, rows binary")


def fit(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", lang_col="lang", part_rows=PART_ROWS, part_words=PART_WORDS) -> dict | None:
    """Train on every labelled row, texts taken whole. Repeated rows count once.

    Tables of at most `part_rows` rows and `part_words` words are taught at once. Larger ones are
    dealt into parts of about that size by a hash; see _by_parts().
    """
    kind = docs.schema[id_col].dataType
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast(kind).alias("doc_id"), F.col(label_col).cast("int").alias("label")).distinct()
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text"))
    with scratch() as keep:
        found = keep(packed(likely(texts, rows.select("doc_id"), labels.count()).join(rows, "doc_id")), "taught")
        held = found.agg(F.count("*").alias("rows"), F.sum("words").alias("words")).first()
        if held.rows <= part_rows and (held.words or 0) <= part_words:
            table = found.toArrow().sort_by([("label", "ascending"), ("key", "ascending")])
            return train(_lists(table), table.column("label").to_pylist(), table.column("lang").to_pylist())
        return _by_parts(found, max(-(-held.rows // part_rows), -(-held.words // part_words)), keep)


def _lists(table) -> list[np.ndarray]:
    kind = np.min_scalar_type(TABLE - 1)
    return [np.frombuffer(b, kind).reshape(-1, 2) for b in table.column("rows").to_pylist()]


def _by_parts(found: DataFrame, parts: int, keep, *, passes=2, dim=8, filters=6, batch=48, rate=0.02, seed=11) -> dict | None:
    """The model of a table too large to be taught at once.

    The log odds count all rows that are taught. From there each part trains weights of its own, going
    `passes` times through all its rows (the fewer of a label are repeated to match the others), and
    the weights are averaged: for a table row over the parts that changed it. Temperature and thresholds count all rows
    kept out, a fourth, by their responses on a grid. Rows of a rare label go to several parts.
    The driver gets sums, whose number the tables of the model set.
    """
    draw = lambda name, n: F.pmod(F.xxhash64("key", F.lit(name)), F.lit(n))
    learn, held = found.where(draw("held", 4) != 0), found.where(draw("held", 4) == 0)
    sizes = {r.label: r.n for r in learn.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    times = F.when(F.col("label") == min(sizes, key=sizes.get), min(parts, -(-RARE * parts // min(sizes.values())))).otherwise(1)
    copies = learn.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1))).withColumn("part", F.pmod(draw("part", parts) + F.col("copy"), F.lit(parts)))

    def count(batches):
        seen = np.zeros((2, TABLE + 1))
        for b in tx.chunks(batches, column="rows"):
            y = b.column("label").to_numpy()
            seen[:, :TABLE] += occurrences(_lists(b), y, TABLE)
            seen[:, TABLE] += (y == 0).sum(), (y == 1).sum()
        at = np.flatnonzero(seen.any(axis=0))  # the last row, beyond the table, holds how many texts there are
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["row", "clean", "toxic"])

    counts = learn.mapInArrow(count, "row long, clean double, toxic double")
    counts = keep(counts.groupBy("row").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "counts").toArrow()
    seen = np.zeros((2, TABLE + 1))
    seen[:, counts.column("row").to_numpy()] = counts.column("clean").to_numpy(), counts.column("toxic").to_numpy()
    lean = odds(seen[:, :TABLE], *seen[:, TABLE])
    first = beginning(lean, dim, filters, np.random.default_rng(seed))
    dense = [k for k in first if k != "emb"]

    def teach(table: pa.Table) -> pa.Table:
        number = table.column("part")[0].as_py()
        table = table.sort_by([("label", "ascending"), ("key", "ascending")])
        y, rng = table.column("label").to_numpy().astype(float), np.random.default_rng([seed, number])
        kinds = [np.flatnonzero(y == v) for v in (0, 1)]
        p = beginning(lean, dim, filters, np.random.default_rng(seed))
        before = p["emb"].copy()
        if all(map(len, kinds)):
            half = batch // 2
            steps = passes * -(-max(map(len, kinds)) // half)
            turns = [np.concatenate([rng.permutation(k) for _ in range(-(-steps * half // len(k)))]) for k in kinds]
            p = descend(p, _lists(table), y, ([t[i * half : (i + 1) * half] for t in turns] for i in range(steps)), rate, filters)
        moved = np.flatnonzero((p["emb"] != before).any(axis=1))
        small = np.concatenate([p[k].ravel() for k in dense])
        values = [*p["emb"][moved].tolist(), small.tolist()]  # the last row, beyond the table, holds all other weights
        return pa.table({"row": pa.array(np.append(moved, TABLE)), "weights": pa.array(values, pa.list_(pa.float64()))})

    taught = copies.groupBy("part").applyInArrow(teach, "row long, weights array<double>")
    means = taught.select("row", F.posexplode("weights").alias("at", "weight")).groupBy("row", "at").agg(F.avg("weight").alias("weight"))
    means = keep(means, "weights").toArrow()
    row, at, weight = (means.column(c).to_numpy() for c in ("row", "at", "weight"))
    p, own = first, row < TABLE
    p["emb"][row[own], at[own]] = weight[own]
    small = np.zeros(sum(p[k].size for k in dense))
    small[at[~own]] = weight[~own]
    ends = np.cumsum([p[k].size for k in dense])
    p |= {k: part.reshape(p[k].shape) for k, part in zip(dense, np.split(small, ends[:-1]))}
    model = {"table": TABLE, "shift": 0.0, "heat": 1.0, "langs": {}} | p
    model["emb"] = p["emb"].astype(np.float32)

    def respond(batches):
        for b in tx.chunks(batches, column="rows", limit=1 << 21):
            bins = np.round(raw_responses(model, _lists(b)) / STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("lang"), pa.array(bins)], ["label", "lang", "bin"])

    bins = held.mapInArrow(respond, "label int, lang string, bin long")
    bins = keep(bins.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "bin").agg(F.count("*").alias("n"), F.sum("label").alias("hits")), "bins").toArrow()
    raw, n, hits = bins.column("bin").to_numpy() * STEP, bins.column("n").to_numpy().astype(float), bins.column("hits").to_numpy().astype(float)
    if not 0 < hits.sum() < n.sum():
        return model | {"shift": float(np.log(CUT / (1 - CUT)))}
    heats = np.geomspace(0.2, 20, 40)
    loss = [np.sum(hits * np.logaddexp(0, -raw / t) + (n - hits) * np.logaddexp(0, raw / t)) for t in heats]
    lang_of = np.array(bins.column("lang").to_pylist())
    return calibrated(model, float(heats[int(np.argmin(loss))]), raw, n, hits, lang_of)


def filter_maps(model: dict) -> np.ndarray:
    """All filters side by side, those of one width by their place in the window."""
    return np.concatenate([model[f"f{w}"][k] for w in WIDTHS for k in range(w)], axis=1)


def responses(model: dict, shares: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The logit of each text before calibration; shares: each word's part in every filter, one text after another."""
    filters, hidden, at = len(model["b1"]), [], 0
    for w in WIDTHS:
        parts = [shares[:, at + k * filters : at + (k + 1) * filters] for k in range(w)]
        at += w * filters
        hidden.append(_pooled(parts, sizes, w, model[f"b{w}"])[0])
    return np.maximum(np.concatenate(hidden, axis=1), 0) @ model["out"] + model["bias"][0]


class Scorer:
    """Scores of texts: each distinct word's share in every filter is worked out once."""

    def __init__(self, model: dict):
        self.m, self.words, self.maps = model, Words(model["table"]), filter_maps(model)
        self.share = np.zeros((0, self.maps.shape[1]))

    def score(self, texts: list[str | None]) -> np.ndarray:
        ids = self.words.ids(texts)
        known = len(self.words.known)
        if known < len(self.share):  # the words have started anew
            self.share = self.share[:0]
        fresh = self.m["emb"][self.words.rows[len(self.share) : known]].astype(np.float64).sum(axis=1) @ self.maps
        self.share = np.concatenate([self.share, fresh])
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        return _sigmoid(responses(self.m, self.share[flat], sizes) / self.m["heat"] + self.m["shift"])


def score(docs: DataFrame, model: dict | None, *, id_col="doc_id", text_col="text", lang_col=None) -> DataFrame:
    """(id, score) of every whole text; narrow. The model's tables are of a fixed size and go with the tasks.

    lang_col: a column that is not scored but carried along as `lang`, and for whose values the model
    has thresholds: then `threshold` (the common one where a language has none) and
    `over_threshold`, whether the score reaches it, follow.
    """
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        scorer = None
        for batch in tx.chunks(batches, limit=1 << 19):
            if model is None:
                found = np.zeros(batch.num_rows)
            else:
                scorer = scorer or Scorer(model)
                found = scorer.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(found)], ["doc_id", "lang", "score"])

    kind = source.schema["doc_id"].dataType.simpleString()
    out = source.mapInArrow(run, f"doc_id {kind}, lang string, score double")
    out = flagged(out, model) if lang_col else out.drop("lang")
    return out.withColumnRenamed("doc_id", id_col)


def flagged(scored: DataFrame, model: dict | None) -> DataFrame:
    limit = F.lit(CUT)
    for lang, value in (model or {"langs": {}})["langs"].items():
        limit = F.when(F.col("lang") == lang, F.lit(value)).otherwise(limit)
    return scored.withColumn("threshold", limit).withColumn("over_threshold", F.col("score") >= F.col("threshold"))
