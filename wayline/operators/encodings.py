"""Symbolic encodings of packed trajectories, and distances between the strings."""

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import between, let


def _letter(step: Column) -> Column:
    return F.char(F.lit(65) + step)


def _bin(share: Column, k: int, wrap: bool) -> Column:
    """The bin of a share of 1 among k; the end belongs to the first bin (directions) or the last (lengths)."""
    step = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * k).cast("int")
    return F.when(step >= k, 0 if wrap else k - 1).otherwise(step)


def _turns(steps: Column) -> Column:
    """Headings of steps (from a to b) as shares of a full turn. By the C library's atan2, as SQL engines take it: the JVM's
    differs in the last bit, and a heading between two bins, or two equal headings, then get other letters."""

    @F.arrow_udf("array<double>")
    def headings(rise: pa.Array, run: pa.Array) -> pa.Array:
        pairs = zip(rise.flatten().to_pylist(), run.flatten().to_pylist())
        angles = [None if y is None or x is None else math.atan2(y, x) for y, x in pairs]
        ends = rise.value_lengths().fill_null(0).to_numpy().cumsum()
        return pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(angles, pa.float64()), mask=rise.is_null())

    angles = headings(F.transform(steps, lambda p: p["b"]["y"] - p["a"]["y"]), F.transform(steps, lambda p: p["b"]["x"] - p["a"]["x"]))
    return F.transform(angles, lambda a: (a + math.pi) / (2 * math.pi))


def _pairs(pts: Column) -> Column:
    n = F.greatest(F.size(pts) - 1, F.lit(0))
    return F.zip_with(F.slice(pts, 1, n), F.slice(pts, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _text(letters: Column) -> Column:
    return F.array_join(letters, "")


def global_direction(pts: Column, k: int = 8) -> Column:
    """Heading of every step."""
    return _text(F.transform(_turns(_pairs(pts)), lambda t: _letter(_bin(t, k, True))))


def global_direction_fsp(pts: Column, k: int = 8) -> Column:
    """Heading from every point but the last to the first."""
    back = F.transform(_pairs(pts), lambda p: F.struct(p["a"].alias("a"), F.get(pts, 0).alias("b")))
    return _text(F.transform(_turns(back), lambda t: _letter(_bin(t, k, True))))


def local_direction(pts: Column, k: int = 8) -> Column:
    """How far the heading turns back from every step to the one before it."""
    back = lambda now, before: F.when(before < now, before + 1 - now).otherwise(before - now)

    def changes(turns):
        n = F.greatest(F.size(turns) - 1, F.lit(0))
        return _text(F.transform(F.zip_with(F.slice(turns, 2, n), F.slice(turns, 1, n), back), lambda c: _letter(_bin(c, k, True))))

    return let(_turns(_pairs(pts)), changes)


def _lengths(d: Column, k: int) -> Column:
    given = F.struct(d.alias("d"), F.array_max(d).alias("most"))
    return let(given, lambda g: _text(F.transform(g["d"], lambda x: _letter(_bin(F.when(g["most"] > 0, x / g["most"]).otherwise(0.0), k, False)))))


def step_length(pts: Column, k: int = 16) -> Column:
    """Length of every step as a share of the longest; all `A` where no step has a length."""
    return _lengths(F.transform(_pairs(pts), lambda p: between(p["a"], p["b"])), k)


def step_length_fsp(pts: Column, k: int = 16) -> Column:
    """Distance of every point but the first from the first, as a share of the largest."""
    first = F.get(pts, 0)
    return _lengths(F.transform(_pairs(pts), lambda p: between(p["b"], first)), k)


FEATURES = {
    "global_direction": global_direction,
    "global_direction_FSP": global_direction_fsp,
    "local_direction": local_direction,
    "length": step_length,
    "length_FSP": step_length_fsp,
}


def encode(pts: Column, feature: str) -> Column:
    if feature not in FEATURES:
        raise ValueError(f"no feature is called {feature!r}; there are {', '.join(FEATURES)}")
    return FEATURES[feature](pts)


def zip_features(pts: Column, features) -> Column:
    """The features' letters step by step, `0` where a feature has no letter."""
    coded = F.struct(*(encode(pts, f).alias(f"f{n}") for n, f in enumerate(features)))
    steps = F.sequence(F.lit(1), F.greatest(F.size(pts) - 1, F.lit(1)))
    letter = lambda c, i: F.when(F.length(c) >= i, F.substr(c, i, F.lit(1))).otherwise("0")
    zipped = let(coded, lambda c: _text(F.transform(steps, lambda i: F.concat(*(letter(c[f"f{n}"], i) for n in range(len(features)))))))
    return F.when(F.size(pts) > 1, zipped).otherwise("")


def tokens(text: Column, k: int) -> Column:
    """The string as tokens of k characters; null where its length is no multiple of k."""
    n = (F.length(text) / k).cast("int")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, (i - 1) * k + 1, F.lit(k)))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) % k == 0, cut)


def _both(a: Column, b: Column, body) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: body(s["a"], s["b"]))


#: Tokens that can be told apart by one character each.
MOST_TOKENS = 50_000


def _spelled(t: Column, known: Column) -> Column:
    """Tokens as one character each: their places in `known`, above the control characters, read as UTF-16."""
    return F.decode(F.unhex(F.array_join(F.transform(t, lambda x: F.lpad(F.hex(F.array_position(known, x) + 256), 4, "0")), "")), "UTF-16BE")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of tokens, which become characters for the built-in function; an error above MOST_TOKENS different ones."""
    few = lambda s: F.when(F.size(s["known"]) > MOST_TOKENS, F.raise_error(F.lit("too many different tokens")).cast("int"))
    given = F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("known"))
    return let(given, lambda s: few(s).otherwise(F.levenshtein(_spelled(s["a"], s["known"]), _spelled(s["b"], s["known"]))))


def bigrams(t: Column) -> Column:
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda x, y: F.concat(x, y))


def spectrum(pairs: Column, size: Column) -> Column:
    """Singular values of the one-hot matrix of bigrams, largest first, filled up with zeros to `size` and summing to one: the roots of the counts."""
    roots = F.transform(F.array_distinct(pairs), lambda b: F.sqrt(F.size(F.filter(pairs, lambda x: x == b)).cast("double")))
    full = F.concat(F.sort_array(roots, asc=False), F.array_repeat(F.lit(0.0), F.greatest(size - F.size(roots), F.lit(0))))

    def shares(v):
        total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
        return let(total, lambda t: F.transform(F.slice(v, 1, F.greatest(size, F.lit(1))), lambda x: x / t))

    return let(full, shares)


def spectral_distance(t1: Column, t2: Column) -> Column:
    """Euclidean distance of two token arrays' spectra; the second is cut, or filled up with `NA`, to the first's length."""
    n = F.size(t1)
    same = F.slice(F.concat(t2, F.array_repeat(F.lit("NA"), F.greatest(n - F.size(t2), F.lit(0)))), 1, F.greatest(n, F.lit(1)))

    def compare(p1, p2):
        size = F.size(F.array_union(p1, p2))
        return F.sqrt(F.aggregate(F.zip_with(spectrum(p1, size), spectrum(p2, size), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))

    return _both(bigrams(t1), bigrams(same), compare)


STRING_DISTANCES = ("edit_distance", "AAA_distance")


def string_distance(name: str, a: Column, b: Column, k: int) -> Column:
    """A distance of two strings of k-character tokens."""
    if name == "edit_distance":
        return F.levenshtein(a, b) if k == 1 else _both(tokens(a, k), tokens(b, k), edit_distance)
    if name == "AAA_distance":
        return _both(tokens(a, k), tokens(b, k), spectral_distance)
    raise ValueError(f"no string distance is called {name!r}; there are {', '.join(STRING_DISTANCES)}")


def one_hot(coded: DataFrame, alphabet: int, start: str = "A", text: str = "code") -> DataFrame:
    """(tid, row, col): the one-hot bigram matrix of each string, by its entries; bigrams outside the alphabet have none."""
    at = lambda i: F.ascii(F.substr(F.col(text), i, F.lit(1))) - ord(start)
    rows = coded.where(F.length(text) > 1).select("tid", text, F.explode(F.sequence(F.lit(1), F.length(text) - 1)).alias("col"))
    a, b = at(F.col("col")), at(F.col("col") + 1)
    inside = (a >= 0) & (a < alphabet) & (b >= 0) & (b < alphabet)
    return rows.where(inside).select("tid", (a * alphabet + b + 1).alias("row"), "col")


def one_hot_cross(a: DataFrame, b: DataFrame, rows_b: int) -> DataFrame:
    """The column-wise product of two one-hot matrices: row (i - 1) * rows_b + j where column holds i and j."""
    right = b.select("tid", "col", F.col("row").alias("other"))
    return a.join(right, ["tid", "col"]).select("tid", ((F.col("row") - 1) * rows_b + F.col("other")).alias("row"), "col")


def bigram_name(row: Column, alphabet: int, start: str = "A") -> Column:
    """The two characters that a row of a one-hot matrix stands for."""
    letter = lambda k: F.char(F.lit(ord(start)) + k)
    return F.concat(letter(F.floor((row - 1) / alphabet)), letter((row - 1) % alphabet))


def cross_name(row: Column, a: tuple[int, str], b: tuple[int, str]) -> Column:
    """The names of both rows that a row of one_hot_cross() stands for, with a comma between; a, b: alphabet and first character of each side."""
    many = b[0] ** 2
    return F.concat_ws(",", bigram_name(F.floor((row - 1) / many) + 1, *a), bigram_name((row - 1) % many + 1, *b))


def singular_profile(entries: DataFrame, size: int, na_rm: bool = True) -> DataFrame:
    """(tid, rank, value): normalised singular values of each one-hot matrix, zeros up to `size`.

    na_rm: where it is not set, a matrix with fewer than `size` values has missing ones, which makes all of its values null.
    """
    roots = entries.groupBy("tid", "row").agg(F.sqrt(F.count("*").cast("double")).alias("v")).groupBy("tid").agg(F.sort_array(F.collect_list("v"), asc=False).alias("vs"))
    total = F.aggregate("vs", F.lit(0.0), lambda s, x: s + x)
    full = F.slice(F.concat("vs", F.array_repeat(F.lit(0.0), size)), 1, size)
    known = F.lit(True) if na_rm else F.size("vs") >= size
    return roots.select("tid", F.posexplode(F.transform(full, lambda x: F.when(known, x / total))).alias("rank", "value"))
