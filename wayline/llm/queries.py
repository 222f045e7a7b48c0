"""The registered queries of this subpackage: each applies its operator to its whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from . import alignment, bpe, decontamination, fill_middle, language_id, nearest, pieces, quotation, simhash, substring_dedup, token_counts, toxicity, warc

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(modulus):
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query
def op1_language_id(spark, sf_dir):
    """The language of every whole text; learned from labelled rows whose crc32 remainder is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(remainder(4) != 2))
    found = language_id.predict(docs, model)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


@query
def op2_token_counts(spark, sf_dir):
    """Tokens of every whole text under the byte-level vocabulary, against a limit of 1024."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@query
def op8_simhash(spark, sf_dir):
    """SimHash fingerprints of three-word shingles, and classes of fingerprints within two bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_substring_dedup(spark, sf_dir):
    """What stays of every whole text without the 50-word windows that also start in a smaller document."""
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op10_bpe(spark, sf_dir):
    """Ids of every whole text under the vocabulary with word ends, and the text that they decode to, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = bpe.round_trip(table(spark, sf_dir, "documents"), path)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_toxicity(spark, sf_dir):
    """Toxicity of every whole text; learned from labelled rows whose crc32 remainder is not 1. threshold and over_threshold: the
    cut of the row's language and whether the score reaches it."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder(3) != 1))
    found = toxicity.score(docs, model, lang_col="lang")
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "threshold", "over_threshold")


@query
def op4_decontamination(spark, sf_dir):
    """The benchmark items that occur in each document, with their distance and place."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_quotation(spark, sf_dir):
    """Messages without quotes, the turn that each answers and its place in reply order."""
    return quotation.reply_order(table(spark, sf_dir, "conversations"))


ORACLES["op7_quotation"] = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS raw FROM conversations
), l AS (
  SELECT id, conv_id, turn, unnest(raw) AS line, generate_subscripts(raw, 1) AS i FROM m
), d AS (
  SELECT id, conv_id, turn, i, length(regexp_replace(regexp_extract(line, '^\s*((?:>\s?)+)', 1), '[^>]', '', 'g')) AS depth,
         regexp_replace(line, '^\s*((?:>\s?)+)', '') AS line FROM l
), k AS (
  SELECT *, trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')) AS words, lead(depth, 1, 0) OVER (PARTITION BY id ORDER BY i) AS below FROM d
), w AS (
  SELECT id, conv_id, turn, i, depth, unnest(string_split(words, ' ')) AS word, generate_subscripts(string_split(words, ' '), 1) AS j FROM k WHERE words <> ''
), g AS (
  SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY i, j) AS passage
  FROM (SELECT *, CASE WHEN depth = lag(depth) OVER (PARTITION BY id ORDER BY i, j) THEN 0 ELSE 1 END AS fresh FROM w)
), runs AS (
  SELECT * FROM (
    SELECT id, conv_id, turn, depth, list(word) OVER five AS run, list_distinct(list(i) OVER five) AS places, row_number() OVER (PARTITION BY id, passage ORDER BY i, j) AS p
    FROM g WINDOW five AS (PARTITION BY id, passage ORDER BY i, j ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
  WHERE len(run) = 5 OR p = 1
), first_runs AS (
  SELECT conv_id, run, min(turn) AS original FROM runs WHERE depth = 0 GROUP BY 1, 2
), hits AS (
  SELECT r.id, r.i, f.original, count(*) AS n
  FROM (SELECT id, conv_id, turn, run, unnest(places) AS i FROM runs WHERE depth > 0) r JOIN first_runs f USING (conv_id, run) WHERE f.original < r.turn GROUP BY 1, 2, 3
), by_runs AS (
  SELECT id, i, arg_max(original, n * 1000000000 + original) AS original FROM hits GROUP BY 1, 2
), first_lines AS (
  SELECT conv_id, words, min(turn) AS original FROM k WHERE depth = 0 AND words <> '' GROUP BY 1, 2
), linked AS (
  SELECT q.conv_id, q.turn, q.depth,
         CASE WHEN len(string_split(q.words, ' ')) < 5 THEN coalesce(b.original, f.original) ELSE coalesce(f.original, b.original) END AS original, count(*) AS n
  FROM k q LEFT JOIN by_runs b ON b.id = q.id AND b.i = q.i LEFT JOIN first_lines f ON f.conv_id = q.conv_id AND f.words = q.words AND f.original < q.turn
  WHERE q.depth > 0 AND q.words <> '' AND coalesce(b.original, f.original) IS NOT NULL GROUP BY 1, 2, 3, 4
), parents AS (
  SELECT conv_id, turn, arg_max(original, n * 1000000000 + original) FILTER (WHERE depth = 1) AS reply_to, sum(n)::BIGINT AS n_linked FROM linked GROUP BY 1, 2
), up AS (
  SELECT conv_id, turn, reply_to AS thread, 1::BIGINT AS thread_depth FROM parents WHERE reply_to IS NOT NULL
  UNION ALL
  SELECT up.conv_id, up.turn, p.reply_to, up.thread_depth + 1 FROM up JOIN parents p ON p.conv_id = up.conv_id AND p.turn = up.thread AND p.reply_to IS NOT NULL
), roots AS (
  SELECT conv_id, turn, arg_max(thread, thread_depth) AS thread, max(thread_depth) AS thread_depth FROM up GROUP BY 1, 2
), own AS (
  SELECT id, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE depth = 0 AND NOT (below > 0 AND regexp_matches(line,
           '(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$'))), ''), '^\s+|\s+$', '', 'g') AS text,
         max(depth)::INT AS max_depth, count(*) FILTER (WHERE depth > 0) AS n_quoted FROM k GROUP BY id
)
SELECT m.conv_id, m.turn, m.role, own.text, own.max_depth, own.n_quoted, coalesce(p.n_linked, 0) AS n_linked, p.reply_to,
       coalesce(r.thread, m.turn) AS thread, coalesce(r.thread_depth, 0) AS thread_depth
FROM m JOIN own USING (id) LEFT JOIN parents p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN roots r ON r.conv_id = m.conv_id AND r.turn = m.turn
"""


@query
def op9_warc(spark, sf_dir):
    """Metadata and conversion records of every crawled page."""
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")), keep="page_id")


@query
def op3_nearest(spark, sf_dir):
    """The ten nearest found of every vector whose id is divisible by 100."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op11_fill_middle(spark, sf_dir):
    """Fill-in-middle examples of every whole text, as digests of the output and of the text rebuilt from it."""
    made = fill_middle.transform(table(spark, sf_dir, "documents"))
    rebuilt = fill_middle.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))


ORACLES["op11_fill_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS s FROM documents
), h AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""


@query
def op13_pieces(spark, sf_dir):
    """Piece ids of every whole text, and the text that they decode to, as digests."""
    tokens = pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op12_alignment(spark, sf_dir):
    """How the tokens of two vocabularies overlap in every whole text, against the counts of all id pairs in the corpus."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.align(table(spark, sf_dir, "documents"), *paths)
    groups = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", groups.alias("groups_sha256"))
