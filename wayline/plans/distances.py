"""Queries on distances between trajectories."""

from pyspark.sql import functions as F

from ..functions import trajectories as tr
from ..operators import compare, frechet, search, spec, wavefront
from ..operators import points as pt
from . import tables as t
from .registry import query, r6

#: The trajectory that searches start from: the smallest user.
_Q = f"WITH {t.EVENTS}, q AS (SELECT * FROM p WHERE tid = (SELECT min(tid) FROM p)), o AS (SELECT * FROM p WHERE tid <> (SELECT min(tid) FROM p))"
_D = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)"


def _database(spark, sf_dir):
    db = pt.pack(t.events(spark, sf_dir))
    first = db.agg(F.min("tid")).first()[0]
    return db, compare.query_row(db, first)


_HAUSDORFF = f"""{_Q}, d AS (SELECT b.tid, a.seq AS i, b.seq AS j, {_D} AS d FROM q a, o b), f AS (
  SELECT tid, max(m) AS m FROM (SELECT tid, i, min(d) AS m FROM d GROUP BY 1, 2 UNION ALL SELECT tid, j, min(d) FROM d GROUP BY 1, 2) GROUP BY tid)"""


@query(f"{_HAUSDORFF} SELECT (SELECT min(tid) FROM p) AS query_tid, tid, round(m, 6) AS distance FROM f ORDER BY m, tid LIMIT 10")
def knn_hausdorff(spark, sf_dir):
    db, asked = _database(spark, sf_dir)
    return compare.nearest(db, asked, "discrete_hausdorff", 10).withColumn("distance", r6(F.col("distance")))


@query(f"""{_Q}, d AS (SELECT b.tid, a.seq AS i, b.seq AS j, {_D} AS d FROM q a, o b) SELECT tid, i, round(min(d), 6) AS nearest_vertex FROM d GROUP BY 1, 2""")
def point_to_vertices(spark, sf_dir):
    db, asked = _database(spark, sf_dir)
    rows = db.crossJoin(F.broadcast(asked)).where("tid <> query_tid").select("tid", "pts", F.posexplode("query_pts").alias("i", "p"))
    return rows.select("tid", F.col("i").cast("long").alias("i"), r6(tr.point_to_vertices(F.col("p"), F.col("pts"))).alias("nearest_vertex"))


@query(f"""{_Q}, s AS (SELECT tid, x AS ux, y AS uy, lead(x) OVER w AS vx, lead(y) OVER w AS vy FROM o WINDOW w AS (PARTITION BY tid ORDER BY seq)),
  k AS (SELECT s.*, q.seq AS i, q.x, q.y, least(greatest(((q.x - ux) * (vx - ux) + (q.y - uy) * (vy - uy)) / ((vx - ux) ** 2 + (vy - uy) ** 2), 0), 1) AS f FROM s, q WHERE vx IS NOT NULL)
  SELECT tid, i, round(min(sqrt((x - ux - f * (vx - ux)) ** 2 + (y - uy - f * (vy - uy)) ** 2)), 6) AS nearest_segment FROM k GROUP BY 1, 2""")
def point_to_trajectory(spark, sf_dir):
    db, asked = _database(spark, sf_dir)
    rows = db.crossJoin(F.broadcast(asked)).where("tid <> query_tid").select("tid", "pts", F.posexplode("query_pts").alias("i", "p"))
    return rows.select("tid", F.col("i").cast("long").alias("i"), r6(tr.point_to_trajectory(F.col("p"), F.col("pts"))).alias("nearest_segment"))


_PAIRS = f"WITH {t.VECTORS}, k AS (SELECT a.grp, a.tid AS i, b.tid AS j, a.seq AS s, b.seq AS r, {_D} AS d FROM p a JOIN p b ON a.grp = b.grp AND a.tid < b.tid"


def _pairs(spark, sf_dir, name):
    return compare.within_groups(t.vectors(spark, sf_dir), name).withColumn("distance", r6(F.col("distance")))


@query(f"{_PAIRS} AND a.seq = b.seq) SELECT grp, i, j, round(sum(d), 6) AS distance FROM k GROUP BY 1, 2, 3")
def distance_matrix_upper(spark, sf_dir):
    return _pairs(spark, sf_dir, "sum_of_pairs")


@query(f"{_PAIRS} AND a.seq = b.seq) SELECT grp, i, j, round(sqrt(sum(d * d)), 6) AS distance FROM k GROUP BY 1, 2, 3")
def dtw_lockstep(spark, sf_dir):
    return _pairs(spark, sf_dir, "dtw")


_QV = f"WITH {t.VECTORS}, d AS (SELECT b.tid, a.seq AS i, b.seq AS j, {_D} AS d FROM p a, p b WHERE a.tid = (SELECT min(tid) FROM p) AND b.tid <> a.tid)"


def _vector_query(spark, sf_dir, *names):
    db = t.vectors(spark, sf_dir)
    asked = compare.query_row(db, db.agg(F.min("tid")).first()[0])
    found = compare.distance_to(db.where(F.col("tid") != asked.first().query_tid), asked, *names)
    return found.select("tid", *(r6(F.col(n)).alias(n) for n in names))


@query(f"{_QV} SELECT tid, round(min(d), 6) AS closest_pair FROM d GROUP BY tid")
def closest_pair(spark, sf_dir):
    return _vector_query(spark, sf_dir, "closest_pair")


@query(f"{_QV} SELECT tid, round(sum(d), 6) AS sum_of_pairs FROM d WHERE i = j GROUP BY tid")
def sum_of_pairs(spark, sf_dir):
    return _vector_query(spark, sf_dir, "sum_of_pairs")


_HV = f"{_QV}, h AS (SELECT tid, max(m) AS m FROM (SELECT tid, i, min(d) AS m FROM d GROUP BY 1, 2 UNION ALL SELECT tid, j, min(d) FROM d GROUP BY 1, 2) GROUP BY tid)"


@query(f"{_HV} SELECT tid, round(m, 6) AS discrete_hausdorff FROM h")
def discrete_hausdorff(spark, sf_dir):
    return _vector_query(spark, sf_dir, "discrete_hausdorff")


# rows of the coupling table one after another; a row is a list that a running reduction makes of the row above
_ROWS = """, v AS (SELECT tid, i, list(d ORDER BY j) AS ds FROM d GROUP BY tid, i), s AS (SELECT tid, list(ds ORDER BY i) AS rows FROM v GROUP BY tid)"""
_FRECHET = """list_reduce(rows[2:], lambda above, ds: list_reduce(list_zip(ds, above, list_prepend(NULL, above[:-2])),
  lambda row, z: list_append(row, greatest(least(z[2], coalesce(z[3], z[2]), coalesce(row[-1], z[2])), z[1])), CAST([] AS DOUBLE[])),
  list_reduce(rows[1], lambda row, x: list_append(row, greatest(coalesce(row[-1], 0), x)), CAST([] AS DOUBLE[])))"""


@query(f"{_QV}{_ROWS} SELECT tid, round(({_FRECHET})[-1], 6) AS discrete_frechet FROM s")
def discrete_frechet(spark, sf_dir):
    """Discrete Fréchet distance of every vector's trajectory to the first, by waves."""
    db = t.vectors(spark, sf_dir)
    asked = compare.query_row(db, db.agg(F.min("tid")).first()[0])
    pairs = db.crossJoin(F.broadcast(asked)).where("tid <> query_tid").select("tid", F.col("pts").alias("u"), F.col("query_pts").alias("v"))
    return wavefront.distances(pairs, "tid").select("tid", r6(F.col("distance")).alias("discrete_frechet"))


@query(f"{_QV}{_ROWS}, e AS (SELECT tid, round(({_FRECHET})[-1], 6) AS distance FROM s) SELECT tid, distance FROM e ORDER BY distance, tid LIMIT 10")
def knn_discrete_frechet(spark, sf_dir):
    """The ten trajectories nearest to the first one by discrete Fréchet distance."""
    db = t.vectors(spark, sf_dir)
    return search.nearest(db, db.agg(F.min("tid")).first()[0], 10).select("tid", r6(F.col("distance")).alias("distance"))


@query()
def knn_frechet(spark, sf_dir):
    """The ten users' trajectories nearest to the smallest user's by continuous Fréchet distance; tested against measuring all."""
    db, asked = _database(spark, sf_dir)
    return search.nearest(db, asked.first().query_tid, 10, continuous=True).select("tid", F.round("distance", 4).alias("distance"))


@query(f"{_HV}, c AS (SELECT tid, min(d) AS c, sum(d) FILTER (i = j) AS s, sqrt(sum(d * d) FILTER (i = j)) AS l FROM d GROUP BY tid) SELECT tid, round(c, 6) AS closest_pair, round(s, 6) AS sum_of_pairs, round(l, 6) AS dtw, round(m, 6) AS discrete_hausdorff FROM h JOIN c USING (tid)")
def distance_spec_multi(spark, sf_dir):
    chosen = spec.group(*(spec.distance(n) for n in ("closest_pair", "sum_of_pairs", "dtw", "discrete_hausdorff")), id="several")
    db = t.vectors(spark, sf_dir)
    asked = compare.query_row(db, db.agg(F.min("tid")).first()[0])
    found = spec.apply(chosen, db.where(F.col("tid") != asked.first().query_tid), asked)
    return found.select("tid", *(r6(F.col(n)).alias(n) for n in chosen.names()))


@query(f"{_QV}, c AS (SELECT tid, round(min(d), 6) AS distance FROM d GROUP BY tid) SELECT p.tid, p.seq, distance FROM p JOIN c USING (tid)")
def distance_vector_rows(spark, sf_dir):
    """The distance of each trajectory on every one of its points."""
    found = _vector_query(spark, sf_dir, "closest_pair").withColumnRenamed("closest_pair", "distance")
    points = pt.unpack(t.vectors(spark, sf_dir)).select("tid", "seq")
    return points.join(found, "tid")


_WARPED = """list_reduce(rows[2:], lambda above, ds: list_reduce(list_zip(ds, above, list_prepend(CAST('Infinity' AS DOUBLE), above[:-2])),
  lambda row, z: list_append(row, least(z[2], z[3], coalesce(row[-1], CAST('Infinity' AS DOUBLE))) + z[1]), CAST([] AS DOUBLE[])),
  list_reduce(rows[1], lambda row, x: list_append(row, coalesce(row[-1], 0) + x), CAST([] AS DOUBLE[])))"""


@query(f"""WITH {t.VECTORS}, d AS (SELECT b.tid, b.seq AS i, a.seq AS j, CASE WHEN abs(a.seq - b.seq) <= 4 THEN {_D} ELSE CAST('Infinity' AS DOUBLE) END AS d
  FROM p a, p b WHERE a.tid = (SELECT min(tid) FROM p)){_ROWS} SELECT tid, round(({_WARPED})[-1], 6) AS dtw_banded FROM s""")
def dtw_banded(spark, sf_dir):
    """True dynamic time warping within a band."""
    db = t.vectors(spark, sf_dir)
    asked = compare.query_row(db, db.agg(F.min("tid")).first()[0])
    pairs = db.crossJoin(F.broadcast(asked)).select("tid", F.col("pts").alias("u"), F.col("query_pts").alias("v"))
    return wavefront.distances(pairs, "tid", "warping", band=4).select("tid", r6(F.col("distance")).alias("dtw_banded"))


@query()
def frechet_continuous(spark, sf_dir):
    """Continuous Fréchet distance of every user's trajectory to the smallest user's; tested against bounds and known cases."""
    db, asked = _database(spark, sf_dir)
    pairs = db.crossJoin(F.broadcast(asked)).where("tid <> query_tid").select("tid", F.col("pts").alias("u"), F.col("query_pts").alias("v"))
    return frechet.distances(pairs, keep="tid").withColumn("frechet", r6(F.col("frechet")))


@query()
def frechet_and_largest(spark, sf_dir):
    """The same with the largest distance between two vertices; tested against bounds and plain loops."""
    db, asked = _database(spark, sf_dir)
    pairs = db.crossJoin(F.broadcast(asked)).where("tid <> query_tid").select("tid", F.col("pts").alias("u"), F.col("query_pts").alias("v"))
    return frechet.distances_and_largest(pairs, keep="tid").select("tid", r6(F.col("frechet")).alias("frechet"), r6(F.col("largest")).alias("largest"))


@query()
def frechet_decide(spark, sf_dir):
    """Whether the continuous Fréchet distance is at most 40; tested against the distance itself."""
    db, asked = _database(spark, sf_dir)
    pairs = db.crossJoin(F.broadcast(asked)).where("tid <> query_tid").select("tid", F.col("pts").alias("u"), F.col("query_pts").alias("v"))
    return frechet.decisions(pairs, 40.0, keep="tid")
