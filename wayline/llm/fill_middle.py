"""Fill-in-middle transformation by lookaround splitting.

A unit grammar says which classes of characters form runs; every other character is a unit of its
own. It is translated into a regular expression of no width that holds between two characters
exactly where a unit ends: not at the edges of the text, and not where both neighbours are of one
run class. Spark's split keeps the pieces whole, in code points. Cut points come from the digest of
the seed and the document's id, so running again gives the same examples. Only DataFrame functions
are used: narrow, no shuffle.

A null text is empty. An empty text has no units and, like one that holds a marker, stays plain: it
comes out as it is. A null id is digested as an empty string. Rows that repeat an id are cut at the
same places if their texts are equal. Only id and text are read, so further columns never clash.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grammars by name: the character classes that form runs. `char` has none; in `line` a unit ends with its newline.
GRAMMARS = {"token": ["A-Za-z"], "char": [], "word": [r"\s", r"\S"], "line": None}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def boundary(runs: list[str] | None) -> str:
    """The zero-width regex of the ends of units, for a grammar given by its run classes."""
    between = r"(?<=[\s\S])(?=[\s\S])"
    if runs is None:
        return rf"(?<=\n){between}"
    return between + "".join(f"(?!(?<=[{c}])(?=[{c}]))" for c in runs)


def units(text: Column, grammar: str | list[str] = "token") -> Column:
    """The units of a text as an array; none of an empty or null text."""
    runs = GRAMMARS[grammar] if isinstance(grammar, str) else grammar
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(runs), -1))


def _group(digest: Column, i: int) -> Column:
    """The i-th eight hex digits of a digest as an unsigned number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, *, id_col="doc_id", text_col="text", grammar: str | list[str] = "token", seed=1, plain=10, spm=20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every document.

    plain: how many of 100 documents stay as they are; spm: how many of 100 others put the suffix first.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    rows = rows.select("doc_id", "text", units(F.col("text"), grammar).alias("units"), *(_group(F.col("digest"), i).alias(f"h{i + 1}") for i in range(4)))
    n = F.size("units")
    cuts = [F.col(h) % (n + 1) for h in ("h1", "h2")]
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= 100 - plain), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "units", n.cast("long").alias("n"), form.alias("form"), F.least(*cuts).cast("int").alias("a"), F.greatest(*cuts).cast("int").alias("b"))
    part = lambda start, length: F.array_join(F.slice("units", start, length), "")
    is_cut = F.col("form") != "plain"
    rows = rows.select(
        "doc_id", "text", "n", "form",
        F.when(is_cut, part(F.lit(1), F.col("a"))).alias("prefix"),
        F.when(is_cut, part(F.col("a") + 1, F.col("b") - F.col("a"))).alias("middle"),
    )
    chars = F.length("prefix"), F.length("middle")
    suffix = F.substring(F.col("text"), chars[0] + chars[1] + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), suffix, F.lit(MIDDLE), "middle")
    spm_form = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_form)
    return rows.select(F.col("doc_id").alias(id_col), "n", "form", *(c.cast("long").alias(f"{name}_chars") for c, name in zip(chars, ("prefix", "middle"))), output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from. Texts with a marker are plain, so each marker stands in an output once."""
    head = F.substring(F.substring_index(output, MIDDLE, 1), 4, 2**31 - 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(head, SUFFIX, 1), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring_index(head, PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
