"""Queries on geohash cells, sets, indexes and Bloom filters."""

from pyspark.sql import functions as F

from ..functions import geohash as gh
from ..operators import bloom, index, slices
from . import tables as t
from .registry import query, r6


def _axes(length, lat="lat", lon="lon"):
    wide, high = (5 * length + 1) // 2, 5 * length // 2
    return (f"CAST(floor({lon} / 180 * {1 << (wide - 1)}.0) AS BIGINT) + {1 << (wide - 1)}", f"CAST(floor({lat} / 90 * {1 << (high - 1)}.0) AS BIGINT) + {1 << (high - 1)}")


def _spelt(x, y, length):
    wide, high = (5 * length + 1) // 2, 5 * length // 2
    letters = []
    for c in range(length):
        bits = [f"((({x}) >> {wide - 1 - k // 2}) & 1) * {1 << (4 - k % 5)}" if k % 2 == 0 else f"((({y}) >> {high - 1 - k // 2}) & 1) * {1 << (4 - k % 5)}" for k in range(5 * c, 5 * c + 5)]
        letters.append(f"substr('{gh.ALPHABET}', CAST({' + '.join(bits)} AS INT) + 1, 1)")
    return " || ".join(letters)


def _cells_sql(length):
    x, y = _axes(length)
    return f"WITH {t.EVENTS}, a AS (SELECT *, {x} AS cx, {y} AS cy FROM p), c AS (SELECT tid, seq, lat, lon, cx, cy, {_spelt('cx', 'cy', length)} AS cell FROM a)"


@query(f"{_cells_sql(8)} SELECT tid, seq, cell FROM c")
def geohash_encode(spark, sf_dir):
    return index.cells(t.events(spark, sf_dir), 8)


@query(f"{_cells_sql(8)} SELECT tid, seq, round(cy / {1 << 20}.0 * 180 - 90, 6) AS lat, round(cx / {1 << 20}.0 * 360 - 180, 6) AS lon FROM c")
def geohash_decode(spark, sf_dir):
    corner = gh.decode(F.col("cell"))
    return index.cells(t.events(spark, sf_dir), 8).withColumn("c", corner).select("tid", "seq", r6(F.col("c.lat")).alias("lat"), r6(F.col("c.lon")).alias("lon"))


_AROUND = " UNION ALL ".join(f"SELECT tid, seq, CAST({n} AS BIGINT) AS step, {_spelt(f'((cx + {dx} + 8192) % 8192)', f'(cy + {dy})', 5)} AS cell FROM c WHERE cy + {dy} BETWEEN 0 AND 4095" for n, (dx, dy) in enumerate(gh.STEPS))


@query(f"{_cells_sql(5)} SELECT tid, seq, cell FROM ({_AROUND})")
def geohash_neighbors(spark, sf_dir):
    return t.events(spark, sf_dir).select("tid", "seq", F.explode(gh.neighbours(F.col("lat"), F.col("lon"), 5)).alias("cell"))


@query(f"{_cells_sql(5)} SELECT tid, string_agg(cell, ',' ORDER BY seq) AS cells FROM c GROUP BY tid")
def geohash_sequence(spark, sf_dir):
    rows = index.cells(t.events(spark, sf_dir), 5).groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("seq", "cell"))).alias("c"))
    return rows.select("tid", F.array_join(F.transform("c", lambda x: x["cell"]), ",").alias("cells"))


_SETS = f"{_cells_sql(2)}, s AS (SELECT DISTINCT tid, cell FROM c), q AS (SELECT cell FROM s WHERE tid = (SELECT min(tid) FROM s))"


def _sets(spark, sf_dir):
    sets = index.cell_sets(t.events(spark, sf_dir), 2)
    first = sets.agg(F.min("tid")).first()[0]
    return sets, sets.where(F.col("tid") == first)


@query(f"{_SETS} SELECT tid, string_agg(cell, ',' ORDER BY cell) AS cells FROM s GROUP BY tid")
def geohash_set(spark, sf_dir):
    return index.packed_sets(_sets(spark, sf_dir)[0]).select("tid", F.array_join("cells", ",").alias("cells"))


@query(f"{_SETS} SELECT cell, string_agg(tid::VARCHAR, ',' ORDER BY tid) AS tids FROM s GROUP BY cell")
def cell_inverted_index(spark, sf_dir):
    return index.inverted(_sets(spark, sf_dir)[0]).select("cell", F.array_join(F.transform("tids", lambda x: x.cast("string")), ",").alias("tids"))


@query(f"{_SETS} SELECT tid, bool_or(cell IN (SELECT cell FROM q)) AS hit FROM s GROUP BY tid")
def cell_plan(spark, sf_dir):
    return index.plan(*_sets(spark, sf_dir))


@query(f"""{_SETS}, m AS (SELECT max(tid) AS most FROM s), h AS (SELECT tid, bool_or(cell IN (SELECT cell FROM q)) AS hit FROM s GROUP BY tid), r AS (
    SELECT 0 AS rest, tid FROM h WHERE hit UNION ALL SELECT 1, i FROM (SELECT unnest(range(most)) AS i FROM m) WHERE i NOT IN (SELECT tid FROM h WHERE hit))
  SELECT row_number() OVER (ORDER BY rest, tid) - 1 AS position, tid, rest = 0 AS hit FROM r""")
def cell_search_order(spark, sf_dir):
    """All ids below the largest, in the order in which a search visits them."""
    sets, asked = _sets(spark, sf_dir)
    return index.search_order(sets, asked, sets.agg(F.max("tid")).first()[0])


_JACCARD = f"{_SETS}, j AS (SELECT tid, count(q.cell) AS shared, count(*) AS size FROM s LEFT JOIN q USING (cell) GROUP BY tid), d AS (SELECT tid, shared, size, 1 - shared / (size + (SELECT count(*) FROM q) - shared) AS d FROM j)"


@query(f"{_JACCARD} SELECT tid, shared, size, round(d, 6) + 0.0 AS distance FROM d")
def jaccard_exact(spark, sf_dir):
    return index.jaccard(*_sets(spark, sf_dir)).withColumn("distance", r6(F.col("distance")))


@query(f"{_JACCARD} SELECT tid, round(d, 6) AS distance FROM d WHERE tid <> (SELECT min(tid) FROM s) ORDER BY d, tid LIMIT 10")
def jaccard_topk(spark, sf_dir):
    sets, asked = _sets(spark, sf_dir)
    found = index.jaccard(sets, asked).join(asked.select("tid").distinct(), "tid", "left_anti")
    return found.orderBy("distance", "tid").limit(10).select("tid", r6(F.col("distance")).alias("distance"))


M, D = 256, 3
_HASHES = " UNION ALL ".join(f"SELECT tid, cell, CAST(('0x' || substr(md5('{i}' || cell), 1, 8))::BIGINT % {M} AS INT) AS pos, {i} AS i FROM s" for i in range(D + 1))
_BLOOM = f"{_SETS}, h AS ({_HASHES}), b AS (SELECT tid, count(DISTINCT cell) AS n, list_sort(list(DISTINCT pos)) AS bits FROM h WHERE i < {D} GROUP BY tid), f AS (SELECT bits AS qbits FROM b WHERE tid = (SELECT min(tid) FROM b))"
_SIZE = f"(-ln(1 - len({{}}) / {M}.0) * {M} / {D})"
_UNION = _SIZE.format("list_distinct(bits || qbits)")


def _filters(spark, sf_dir):
    """Every trajectory's filter beside the first one's."""
    sets, _ = _sets(spark, sf_dir)
    made = bloom.filters(sets, M, D)
    return made.crossJoin(F.broadcast(made.agg(F.min_by("bits", "tid").alias("query"))))


@query(f"{_BLOOM} SELECT tid, n, len(bits) AS ones, round({_SIZE.format('bits')}, 6) AS estimate FROM b")
def bloom_size(spark, sf_dir):
    return bloom.filters(_sets(spark, sf_dir)[0], M, D).select("tid", "n", F.size("bits").cast("long").alias("ones"), r6(bloom.size_estimate(F.col("bits"), M, D)).alias("estimate"))


@query(f"{_BLOOM} SELECT tid, round({_UNION}, 6) AS estimate FROM b, f")
def bloom_union(spark, sf_dir):
    return _filters(spark, sf_dir).select("tid", r6(bloom.union_estimate(F.col("bits"), F.col("query"), M, D)).alias("estimate"))


@query(f"{_BLOOM} SELECT tid, round({_SIZE.format('bits')} + {_SIZE.format('qbits')} - {_UNION}, 6) + 0.0 AS estimate, round(1 - ({_SIZE.format('bits')} + {_SIZE.format('qbits')} - {_UNION}) / {_UNION}, 6) + 0.0 AS jaccard FROM b, f")
def bloom_intersect(spark, sf_dir):
    a, b = F.col("bits"), F.col("query")
    return _filters(spark, sf_dir).select("tid", r6(bloom.intersection_estimate(a, b, M, D)).alias("estimate"), r6(bloom.jaccard_estimate(a, b, M, D)).alias("jaccard"))


_MISSING = "len(list_filter(qbits, lambda x: NOT list_contains(bits, x)))"


@query(f"{_BLOOM} SELECT tid, {_MISSING} = 0 AS inside, round({_MISSING} / len(qbits), 6) + 0.0 AS contradicted FROM b, f")
def bloom_subset(spark, sf_dir):
    a, b = F.col("bits"), F.col("query")
    return _filters(spark, sf_dir).select("tid", bloom.subset(b, a).alias("inside"), r6(bloom.contradictions(b, a)).alias("contradicted"))


@query(f"""{_BLOOM}, k AS (SELECT cell, list(pos) AS pos FROM h WHERE i < {D} AND tid = (SELECT min(tid) FROM s) GROUP BY cell),
  x AS (SELECT b.tid, n, count(*) FILTER (len(list_filter(k.pos, lambda x: NOT list_contains(bits, x))) = 0) AS hits, count(*) AS total FROM b, k GROUP BY b.tid, n)
  SELECT tid, round(1 - hits / (n + total - hits), 6) + 0.0 AS bound FROM x""")
def bloom_lb(spark, sf_dir):
    sets, asked = _sets(spark, sf_dir)
    # the query's keys are one row: as many as one trajectory has cells
    keys = asked.select("cell").distinct().agg(F.collect_list(bloom.md5_positions(F.col("cell"), M, D)).alias("keys"))
    hits = F.size(F.filter("keys", lambda at: bloom.contains(F.col("bits"), at)))
    rows = bloom.filters(sets, M, D).crossJoin(F.broadcast(keys)).select("tid", "n", hits.alias("hits"), F.size("keys").alias("total"))
    return rows.select("tid", r6(bloom.lower_bound(F.col("hits"), F.col("total") - F.col("hits"), F.col("n"))).alias("bound"))


@query(f"{_BLOOM} SELECT tid, {_MISSING} = 0 AS inside FROM b, f")
def bloom_sliced_subset(spark, sf_dir):
    """Which filters hold the first one, by the slices of its bits."""
    made = bloom.filters(_sets(spark, sf_dir)[0], M, D)
    found = slices.build(made)
    asked = made.agg(F.min_by("bits", "tid")).first()[0]
    return found.numbers.select("tid").join(slices.holding(found, asked).withColumn("inside", F.lit(True)), "tid", "left").select("tid", F.coalesce("inside", F.lit(False)).alias("inside"))


@query(f"""{_BLOOM}, k AS (SELECT cell, list(DISTINCT pos) AS pos FROM h WHERE i < {D} GROUP BY cell), t AS (SELECT cell, count(*) AS holders FROM s GROUP BY cell)
  SELECT cell, holders, count(*) FILTER (len(list_filter(k.pos, lambda x: NOT list_contains(bits, x))) = 0) AS candidates FROM b, k JOIN t USING (cell) GROUP BY ALL""")
def bloom_sliced_cells(spark, sf_dir):
    """For every cell, how many trajectories enter it and how many may by their filters, all cells asked at once."""
    sets, _ = _sets(spark, sf_dir)
    found = slices.build(bloom.filters(sets, M, D))
    asked = sets.groupBy(F.col("cell").alias("query")).agg(F.count("*").alias("holders")).withColumn("bits", bloom.md5_positions(F.col("query"), M, D))
    candidates = slices.held(found, asked).groupBy("query").agg(F.count("*").alias("candidates"))
    return asked.join(candidates, "query", "left").select(F.col("query").alias("cell"), "holders", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


_SLICES = 8
_HOLDS = " AND ".join(f"len(list_filter(qbits, lambda x: x // {M // _SLICES} = {i})) <= len(list_filter(bits, lambda x: x // {M // _SLICES} = {i}))" for i in range(_SLICES))


@query(f"{_BLOOM} SELECT tid, {_HOLDS} AS candidate FROM b, f")
def bloom_histogram_filter(spark, sf_dir):
    holds = bloom.may_hold(bloom.histogram(F.col("query"), M, _SLICES), bloom.histogram(F.col("bits"), M, _SLICES))
    return _filters(spark, sf_dir).select("tid", holds.alias("candidate"))


@query(f"""{_cells_sql(2)}, s AS (SELECT tid, cell FROM c), h AS ({_HASHES}), n AS (SELECT tid, pos, count(*) AS n FROM h WHERE i < {D} GROUP BY 1, 2), k AS (SELECT DISTINCT tid, cell, pos FROM h WHERE i < {D})
  SELECT tid, cell, min(n) AS count FROM k JOIN n USING (tid, pos) GROUP BY 1, 2""")
def counting_bloom(spark, sf_dir):
    rows = index.cells(t.events(spark, sf_dir), 2)
    asked = rows.select("tid", "cell").distinct()
    return bloom.counted(bloom.counting(rows, M, D), asked, M, D)


@query(f"{_cells_sql(2)}, s AS (SELECT tid, cell, seq FROM c), h AS ({_HASHES.replace('SELECT tid, cell,', 'SELECT tid, cell, seq,')}) SELECT tid, pos, max(seq) + 10 AS expires FROM h WHERE i < {D} GROUP BY 1, 2")
def decaying_bloom(spark, sf_dir):
    return bloom.decaying(index.cells(t.events(spark, sf_dir), 2).withColumnRenamed("seq", "time"), M, D, 10).withColumnRenamed("at", "pos")


@query(f"{_SETS}, h AS ({_HASHES}), k AS (SELECT *, (('0x' || substr(md5('share' || cell), 1, 8))::BIGINT % 10000) / 9999.0 AS share FROM h) SELECT tid, count(DISTINCT pos) AS ones FROM k WHERE i < 2 OR (i = 2 AND share <= 0.5) GROUP BY tid")
def rational_bloom(spark, sf_dir):
    made = bloom.filters(_sets(spark, sf_dir)[0], positions=lambda c: bloom.rational_positions(c, M, 2.5, bloom.share_of(c)))
    return made.select("tid", F.size("bits").cast("long").alias("ones"))


@query()
def bloom_murmur(spark, sf_dir):
    """Filters by MurmurHash3, which SQL lacks; the hash is tested against published values."""
    made = bloom.filters(index.cell_sets(t.events(spark, sf_dir), 5), 1024, 5, hashes=bloom.murmur_positions)
    return made.select("tid", "n", F.size("bits").cast("long").alias("ones"))


_NARROW = " UNION ALL ".join(f"SELECT tid, CAST(('0x' || substr(md5('{i}' || cell), 1, 8))::BIGINT % 64 AS INT) AS pos FROM s" for i in range(2))


@query(f"""{_cells_sql(1).replace('WITH ', 'WITH RECURSIVE ', 1)}, s AS (SELECT DISTINCT tid, cell FROM c), h AS ({_NARROW}),
  b AS MATERIALIZED (SELECT tid, row_number() OVER (ORDER BY tid) AS r, bits FROM (SELECT tid, list(DISTINCT pos) AS bits FROM h GROUP BY tid)),
  d AS MATERIALIZED (SELECT y.r, list(x.r) AS close FROM b x, b y WHERE x.r < y.r AND len(x.bits) + len(y.bits) - 2 * len(list_intersect(x.bits, y.bits)) < 14 GROUP BY y.r),
  g AS (
    SELECT CAST(1 AS BIGINT) AS r, [CAST(1 AS BIGINT)] AS leaders, CAST(1 AS BIGINT) AS mine
    UNION ALL
    SELECT r, CASE WHEN led IS NULL THEN list_append(leaders, r) ELSE leaders END, coalesce(led, r) FROM (
      SELECT b.r, g.leaders, list_min(list_intersect(g.leaders, coalesce(d.close, []))) AS led FROM g JOIN b ON b.r = g.r + 1 LEFT JOIN d ON d.r = b.r))
  SELECT b.tid, l.tid AS leader FROM g JOIN b USING (r) JOIN b l ON l.r = g.mine""")
def leader_classes(spark, sf_dir):
    """Each trajectory's filter of one-character cells with its leader; decided in rounds, against one pass in order."""
    made = bloom.filters(index.cell_sets(t.events(spark, sf_dir), 1), 64, 2)
    return bloom.leader_classes(made, 14, 64)
