"""Quotation linking: messages that quote earlier ones are joined to them, and conversations are put in reply order without quotes.

A line is quoted as deep as its leading marks (`>`) say. Every line is normalised (lower case,
letters and digits only) and hashed; the original of a quoted line is the first message of the
conversation that wrote the line itself, at depth zero. Consecutive lines of one depth are a passage
too, normalised across line ends; its runs of RUN words (a shorter passage is one run) are hashed,
and a run's original is the first message with that run. A line that no message wrote as it stands,
because it was wrapped anew or starts or ends inside another, and a line of fewer than RUN words
has the original of most of the runs that touch it. A message replies to the original of most
of its lines quoted once, the latest of several; deeper lines link to the originals they came from.
Lines that announce a quotation go with it. Only DataFrame functions are used; the originals of a
line are reduced to the first before they are joined, so a line that very many messages quote or
write never pairs them all.

A null text has no lines. A message whose conversation or turn is null takes no part in links and
is a thread of its own. Rows that repeat a conversation and turn are one message as far as links go
and each stay in the result. Empty quoted lines link to nothing. Further columns are dropped.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import let
from ..storage import discard, materialise, scratch

#: How a quotation is announced, by language.
ANNOUNCES = r"(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
MARKS = r"^\s*((?:>\s?)+)"
#: Words in a run.
RUN = 5


def lines(messages: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Messages with their lines: an array of (depth, text without marks)."""
    split = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n"), "\n")
    cut = F.transform(
        split,
        lambda s: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(s, MARKS, 1), "[^>]", "")).alias("depth"),
            F.regexp_replace(s, MARKS, "").alias("line"),
        ),
    )
    return messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), cut.alias("lines"))


def _key(line):
    return F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " ")


def _words(line):
    return F.filter(F.split(F.trim(_key(line)), " "), lambda w: w != "")


def _runs(rows: DataFrame) -> DataFrame:
    """Messages with `runs`: for each word that begins one, the depth, the hash and the lines of a run of the words of one passage."""
    words = F.flatten(F.transform("lines", lambda l, i: F.transform(_words(l["line"]), lambda w: F.struct(l["depth"].alias("depth"), i.alias("at"), w.alias("word")))))

    def of(ws):
        windows = F.transform(ws, lambda w, i: F.struct(w["depth"].alias("depth"), F.slice(ws, i + 1, RUN).alias("part"), ((i == 0) | (F.get(ws, i - 1)["depth"] != w["depth"])).alias("begins")))
        same = F.transform(windows, lambda r: r.withField("part", F.filter(r["part"], lambda x, k: ~F.exists(F.slice(r["part"], F.lit(1), k + 1), lambda y: y["depth"] != r["depth"]))))
        whole = F.filter(same, lambda r: (F.size(r["part"]) == RUN) | r["begins"])
        return F.transform(whole, lambda r: F.struct(r["depth"].alias("depth"), F.xxhash64(F.array_join(r["part"]["word"], " ")).alias("run"), F.array_distinct(r["part"]["at"]).alias("at")))

    # the words are bound once: as a column they would be inlined into filters on the runs and worked out anew for every word
    return rows.withColumn("runs", let(words, of))


def _hashed(cut: DataFrame) -> DataFrame:
    """(conv_id, turn, message, at, depth, n_words, h1, h2): the quoted lines with words of each message, hashed."""
    rows = cut.select("conv_id", "turn", "message", F.posexplode("lines").alias("at", "l")).where("l.depth > 0")
    rows = rows.select("conv_id", "turn", "message", "at", F.col("l.depth").alias("depth"), F.trim(_key(F.col("l.line"))).alias("key")).where("key <> ''")
    return rows.select("conv_id", "turn", "message", "at", "depth", F.size(F.split("key", " ")).alias("n_words"), F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def links(cut: DataFrame, keep=materialise) -> DataFrame:
    """(conv_id, turn, depth, original, n_lines): which messages a message quotes, how deep and in how many lines. keep writes a table that the result reads."""
    cut = cut.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.xxhash64("lines").alias("message"), "lines")
    quotes = cut.where(F.exists("lines", lambda x: x["depth"] > 0))
    place = ["conv_id", "turn", "message", "at"]
    quoted = _hashed(quotes).groupBy(*place, "depth", "n_words", "h1", "h2").agg(F.count("*").alias("n"))
    quoted = keep(quoted, "quoted")

    written = cut.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi")
    own = written.select("conv_id", "turn", F.explode("lines").alias("l")).where("l.depth = 0").select("conv_id", "turn", F.trim(_key(F.col("l.line"))).alias("key")).where("key <> ''")
    first = own.groupBy("conv_id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")).agg(F.min("turn").alias("original"))
    whole = quoted.join(first, ["conv_id", "h1", "h2"]).where("original < turn").select(*place, F.col("original").alias("by_line"))

    # outer, as the filter of an inner explode would be pushed below the join and work out the runs of every message
    own = _runs(written).select("conv_id", "turn", F.explode_outer("runs").alias("r")).where("r.depth = 0")
    first = own.groupBy("conv_id", F.col("r.run").alias("run")).agg(F.min("turn").alias("original"))
    # a run goes to each line that it touches: a row for each, never all runs beside every line
    touching = _runs(quotes).select("conv_id", "turn", "message", F.explode_outer("runs").alias("r")).where("r.depth > 0")
    touching = touching.select("conv_id", "turn", "message", F.col("r.run").alias("run"), F.explode("r.at").alias("at"))
    parts = touching.join(first, ["conv_id", "run"]).where("original < turn").groupBy(*place, "original").agg(F.count("*").alias("hits"))
    parts = parts.groupBy(*place).agg(F.max(F.struct("hits", "original")).getField("original").alias("by_runs"))

    found = quoted.join(whole, place, "left").join(parts, place, "left")
    original = F.when(F.col("n_words") < RUN, F.coalesce("by_runs", "by_line")).otherwise(F.coalesce("by_line", "by_runs"))
    found = found.withColumn("original", original).where("original IS NOT NULL")
    return found.groupBy("conv_id", "turn", "depth", "original").agg(F.sum("n").alias("n_lines"))


def reply_order(messages: DataFrame, **columns) -> DataFrame:
    """(conv_id, turn, role, text, max_depth, n_quoted, n_linked, reply_to, thread, thread_depth) of every message.

    text: its own lines, without quotes and what announces them; reply_to: the turn it answers, if a
    quote tells; thread: the turn that the chain of replies leads to. (conv_id, thread, turn) is the
    order: an original always stands before its replies.
    """
    cut = lines(messages, **columns)
    with scratch() as keep:
        linked = links(cut, keep).groupBy("conv_id", "turn").agg(
            F.max(F.when(F.col("depth") == 1, F.struct("n_lines", "original"))).getField("original").alias("reply_to"), F.sum("n_lines").alias("n_linked")
        )
        parents = materialise(linked, "replies")
    roots = _roots(parents.where("reply_to IS NOT NULL").select("conv_id", "turn", "reply_to"))
    announced = lambda x, i: ~((x["depth"] == 0) & x["line"].rlike(ANNOUNCES) & (F.coalesce(F.get(F.col("lines"), i + 1)["depth"], F.lit(0)) > 0))
    own = F.filter(F.filter("lines", announced), lambda x: x["depth"] == 0)
    text = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    quoted = F.filter("lines", lambda x: x["depth"] > 0)
    bare = cut.select("conv_id", "turn", "role", text.alias("text"), F.array_max(F.transform("lines", lambda x: x["depth"])).alias("max_depth"), F.size(quoted).cast("long").alias("n_quoted"))
    known = parents.join(roots, ["conv_id", "turn"], "left")
    return bare.join(known, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "max_depth", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to",
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("thread_depth", F.lit(0)).cast("long").alias("thread_depth"),
    )


def _roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, thread_depth) of messages with a parent: every round doubles how far up a chain is known."""
    now = materialise(parents.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("thread_depth")), "chains")
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("thread_depth").alias("more"))
        joined = now.join(up, ["conv_id", "thread"], "left")
        if joined.where("above IS NOT NULL").limit(1).count() == 0:
            return now
        then = materialise(joined.select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"), (F.col("thread_depth") + F.coalesce("more", F.lit(0))).alias("thread_depth")), "chains")
        discard(now)
        now = then


def write_conversations(ordered: DataFrame, path: str) -> None:
    """Write messages as JSON lines in reply order; a conversation is contiguous, and a very long one may span tasks."""
    keys = ["conv_id", "thread", "turn"]
    ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).write.json(path)
