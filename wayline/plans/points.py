"""Queries on points: identifiers, separators, selection, metrics and maps."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import geodesic, resample
from ..operators import points as pt
from . import tables as t
from .registry import query, r6


def _separated(spark, sf_dir):
    """The users' trajectories one after another, a row without coordinates after each."""
    rows = pt.add_separators(t.events(spark, sf_dir))
    return rows.select((F.col("tid") * 1_000_000 + F.col("seq")).alias("pos"), "x", "y")


SEPARATED = f"""WITH {t.EVENTS}, s AS (
  SELECT tid * 1000000 + seq AS pos, x, y FROM p UNION ALL SELECT tid * 1000000 + max(seq) + 1, NULL, NULL FROM p GROUP BY tid
)"""


@query(SEPARATED + " SELECT pos, CASE WHEN x IS NOT NULL THEN 1 + count(*) FILTER (x IS NULL) OVER (ORDER BY pos) END AS tid, y FROM s")
def traj_ids(spark, sf_dir):
    return pt.trajectory_ids(_separated(spark, sf_dir), order="pos").select("pos", "tid", "y")


@query(SEPARATED + " SELECT pos, y FROM s WHERE x IS NOT NULL")
def traj_remove_separators(spark, sf_dir):
    return pt.remove_separators(_separated(spark, sf_dir)).select("pos", "y")


@query(f"WITH {t.EVENTS} SELECT tid, count(*) AS n, round(min(y), 6) AS lo, round(max(y), 6) AS hi, round(arg_min(y, seq), 6) AS first_y, round(arg_max(y, seq), 6) AS last_y FROM p GROUP BY tid")
def traj_pack(spark, sf_dir):
    ys = F.transform("pts", lambda p: p["y"])
    packed = pt.pack(t.events(spark, sf_dir))
    return packed.select("tid", F.size("pts").cast("long").alias("n"), r6(F.array_min(ys)).alias("lo"), r6(F.array_max(ys)).alias("hi"), r6(F.element_at(ys, 1)).alias("first_y"), r6(F.element_at(ys, -1)).alias("last_y"))


@query(f"WITH {t.EVENTS}, n AS (SELECT tid, max(seq) AS m FROM p GROUP BY tid) SELECT tid, seq, y FROM p JOIN n USING (tid) WHERE seq % 15 = 0 OR seq = m")
def uniform_select(spark, sf_dir):
    return pt.uniform_select(t.events(spark, sf_dir), 15).select("tid", "seq", "y")


@query(f"""WITH {t.EVENTS}, v AS (SELECT tid, seq FROM p WHERE y > 20), k AS (
  SELECT tid, seq, lead(seq) OVER w AS nxt, row_number() OVER w AS i, count(*) OVER (PARTITION BY tid) AS n FROM v WINDOW w AS (PARTITION BY tid ORDER BY seq)
) SELECT tid, seq FROM k WHERE i = n OR n < 2 OR (i < n - 1 AND nxt <> seq + 1)""")
def remove_adjacent(spark, sf_dir):
    rows = t.events(spark, sf_dir).where("y > 20").groupBy("tid").agg(F.array_sort(F.collect_list("seq")).alias("v"))
    return rows.select("tid", F.explode(pt.remove_adjacent(F.col("v"))).alias("seq"))


def _neighbours(spark, sf_dir):
    w = Window.partitionBy("tid").orderBy("seq")
    around = {f"{s}{c}": f(c, 1).over(w) for s, f in (("p", F.lag), ("n", F.lead)) for c in ("x", "y")}
    return t.events(spark, sf_dir).withColumns(around)


@query(f"""WITH {t.EVENTS}, k AS (SELECT *, lag(x) OVER w AS ux, lag(y) OVER w AS uy, lead(x) OVER w AS vx, lead(y) OVER w AS vy FROM p WINDOW w AS (PARTITION BY tid ORDER BY seq)),
  f AS (SELECT *, ((x - ux) * (vx - ux) + (y - uy) * (vy - uy)) / ((vx - ux) ** 2 + (vy - uy) ** 2) AS f FROM k WHERE ux IS NOT NULL AND vx IS NOT NULL)
  SELECT tid, seq, round(sqrt((x - (ux + least(greatest(f, 0), 1) * (vx - ux))) ** 2 + (y - (uy + least(greatest(f, 0), 1) * (vy - uy))) ** 2), 6) AS to_segment,
    round(sqrt((x - (ux + f * (vx - ux))) ** 2 + (y - (uy + f * (vy - uy))) ** 2), 6) AS to_line FROM f""")
def point_to_segment(spark, sf_dir):
    rows = _neighbours(spark, sf_dir).where("px IS NOT NULL AND nx IS NOT NULL")
    c = [F.col(n) for n in ("px", "py", "nx", "ny", "x", "y")]
    fx, fy = g.line_projection(*c)
    return rows.select("tid", "seq", r6(g.segment_distance(*c)).alias("to_segment"), r6(g.euclidean(F.col("x"), F.col("y"), fx, fy)).alias("to_line"))


@query(f"""WITH {t.EVENTS}, k AS (SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS "by" FROM p WINDOW w AS (PARTITION BY tid ORDER BY seq))
  SELECT tid, seq, coalesce(round(degrees(acos(greatest(least((ax * bx + ay * "by") / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + "by" * "by")), 1), -1)) * CASE WHEN ax * "by" - ay * bx < 0 THEN -1 ELSE 1 END), 6), 0) + 0.0 AS angle FROM k""")
def turning_angle(spark, sf_dir):
    c = [F.col(n) for n in ("px", "py", "x", "y", "nx", "ny")]
    return _neighbours(spark, sf_dir).select("tid", "seq", r6(F.coalesce(g.turning_angle(*c), F.lit(0.0))).alias("angle"))


_A = f"WITH {t.EVENTS} SELECT tid, seq, round({{0}}, 6) + 0.0 AS x, round({{1}}, 6) + 0.0 AS y FROM p"


def _mapped(spark, sf_dir, transform):
    return transform(t.events(spark, sf_dir)).select("tid", "seq", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(_A.format("2 * x + 0.5 * y + 3", "-1 * x + 4 * y - 2"))
def affine(spark, sf_dir):
    return _mapped(spark, sf_dir, resample.affine(2, 0.5, 3, -1, 4, -2))


@query(_A.format("x + 10", "y - 5"))
def translate(spark, sf_dir):
    return _mapped(spark, sf_dir, resample.translate(10, -5))


@query(_A.format("x * 3", "y * 0.25"))
def scale(spark, sf_dir):
    return _mapped(spark, sf_dir, resample.scale(3, 0.25))


@query(_A.format("x + 0.5 * y", "2 * x + y"))
def skew(spark, sf_dir):
    return _mapped(spark, sf_dir, resample.skew(0.5, 2))


@query(f"""WITH {t.EVENTS}, s AS (SELECT tid, seq, 2 * x + y + 1 AS a, x - y AS b, 0.001 * x + 1 AS w FROM p) SELECT tid, seq, round(a / w, 6) + 0.0 AS x, round(b / w, 6) + 0.0 AS y FROM s""")
def projective_map(spark, sf_dir):
    return _mapped(spark, sf_dir, resample.projective([[2, 1, 1], [1, -1, 0], [0.001, 0, 1]]))


@query(f"""WITH {t.EVENTS}, n AS (SELECT tid, min(x) AS a, max(x) AS b FROM p GROUP BY tid), k AS (SELECT tid, i, a + (b - a) * i / 19.0 AS t FROM n, (SELECT unnest(range(20)) AS i)),
  s AS (SELECT tid, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY tid ORDER BY seq))
  SELECT k.tid, k.i, round(t, 6) AS "at", round(CASE WHEN t = x THEN y ELSE y + (y2 - y) * ((t - x) / (x2 - x)) END, 6) + 0.0 AS y FROM k JOIN s ON k.tid = s.tid AND ((t > x AND t <= x2) OR (i = 0 AND t = x))""")
def pli_resample(spark, sf_dir):
    rows = t.events(spark, sf_dir).select("tid", "seq", F.col("x").alias("t"), "x", "y")
    return resample.interpolate(rows, 20).select("tid", F.col("i").cast("long").alias("i"), r6(F.col("t")).alias("at"), r6(F.col("y")).alias("y"))


@query(f"""WITH {t.EVENTS}, n AS (SELECT tid, seq, y, count(*) OVER (PARTITION BY tid) AS n FROM p), k AS (
  SELECT tid, i, n, y, greatest(least((seq + 1.0), (i + 1.0) * n / 8) - greatest(seq * 1.0, i * 1.0 * n / 8), 0) AS w FROM n, (SELECT unnest(range(8)) AS i))
  SELECT tid, i, round(sum(w * y) / (any_value(n) / 8.0), 6) + 0.0 AS y FROM k GROUP BY tid, i""")
def paa_resample(spark, sf_dir):
    return resample.aggregate_frames(t.events(spark, sf_dir), 8).select("tid", F.col("i").cast("long").alias("i"), r6(F.col("y")).alias("y"))


_HAV = "2 * 6371008.8 * asin(least(1, sqrt(sin(radians(lat2 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(lat2)) * sin(radians(lon2 - lon) / 2) ** 2)))"


@query(f"""WITH {t.EVENTS}, k AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM p WINDOW w AS (PARTITION BY tid ORDER BY seq)) SELECT tid, seq, round({_HAV}, 2) AS metres FROM k WHERE lat2 IS NOT NULL""")
def haversine_steps(spark, sf_dir):
    w = Window.partitionBy("tid").orderBy("seq")
    rows = t.events(spark, sf_dir).withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)}).where("lat2 IS NOT NULL")
    return rows.select("tid", "seq", F.round(g.haversine(*(F.col(c) for c in ("lat", "lon", "lat2", "lon2"))), 2).alias("metres"))


_A, _FLAT = g.WGS84_A, g.WGS84_F
_B2 = (_A * (1 - _FLAT)) ** 2
#: One look at the line of each step under a guess of its longitude on the sphere: arc, azimuth at the equator and what follows.
_LOOK = f"""SELECT *, {_FLAT} / 16 * c2a * (4 + {_FLAT} * (4 - 3 * c2a)) AS c, CASE WHEN c2a > 1e-15 THEN cos(sg) - 2 * s1 * s2 / c2a ELSE 0 END AS cm FROM (
  SELECT *, greatest(1 - sa * sa, 0) AS c2a FROM (
    SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss > 0 THEN c1 * c2 * sin(lam) / ss ELSE 0 END AS sa FROM (
      SELECT t.*, g.i, g.lam, sqrt((c2 * sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * cos(lam)) ** 2) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM g JOIN t USING (tid, seq) WHERE i {{}})))"""
_UP = "ln(tan(radians(greatest(least({}, 89.999999), -89.999999)) / 2 + 0.7853981633974483))"
_WIND = f"degrees(atan2(CASE WHEN d > pi() THEN d - 2 * pi() WHEN d < -pi() THEN d + 2 * pi() ELSE d END, {_UP.format('lat2')} - {_UP.format('lat')})) + 360"


@query(f"""WITH RECURSIVE {t.EVENTS}, k AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM p WINDOW w AS (PARTITION BY tid ORDER BY seq)), z AS (
  SELECT *, atan({1 - _FLAT} * tan(radians(lat))) AS u1, atan({1 - _FLAT} * tan(radians(lat2))) AS u2, radians(lon2 - lon - 360 * floor((lon2 - lon + 180) / 360)) AS far, radians(lon2 - lon) AS d FROM k WHERE lat2 IS NOT NULL
), t AS MATERIALIZED (SELECT *, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2 FROM z), g AS (
  SELECT tid, seq, 0 AS i, far AS lam FROM t
  UNION ALL
  SELECT tid, seq, i + 1, far + (1 - c) * {_FLAT} * sa * (sg + c * sin(sg) * (cm + c * cos(sg) * (2 * cm * cm - 1))) FROM ({_LOOK.format('< 40')})
), m AS (
  SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS big, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS small FROM (SELECT *, c2a * {(_A**2 - _B2) / _B2} AS u FROM ({_LOOK.format('= 40')}))
)
SELECT tid, seq, round({_A * (1 - _FLAT)} * big * (sg - small * sin(sg) * (cm + small / 4 * (cos(sg) * (2 * cm * cm - 1) - small / 6 * cm * (4 * sin(sg) ** 2 - 3) * (4 * cm * cm - 3)))), 3) AS metres,
       round({_WIND} - 360 * floor(({_WIND}) / 360), 6) AS bearing FROM m""")
def wgs84_distance(spark, sf_dir):
    """Geodesic length and rhumb bearing of every step."""
    w = Window.partitionBy("tid").orderBy("seq")
    rows = t.events(spark, sf_dir).withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)}).where("lat2 IS NOT NULL")
    measured = geodesic.lengths(rows.select("tid", "seq", "lat", "lon", "lat2", "lon2"), "lat", "lon")
    return measured.select("tid", "seq", F.round("metres", 3).alias("metres"), F.round(g.rhumb_bearing(*(F.col(n) for n in ("lat", "lon", "lat2", "lon2"))), 6).alias("bearing"))


@query()
def wgs84_to_segment(spark, sf_dir):
    """How far every point is from the geodesic between its neighbours, and where that is nearest; tested against a walk along the line."""
    w = Window.partitionBy("tid").orderBy("seq")
    ends = {"ulat": F.lag("lat").over(w), "ulon": F.lag("lon").over(w), "vlat": F.lead("lat").over(w), "vlon": F.lead("lon").over(w)}
    rows = t.events(spark, sf_dir).withColumns(ends).where("ulat IS NOT NULL AND vlat IS NOT NULL").select("tid", "seq", *ends, "lat", "lon")
    found = geodesic.segment_distances(rows, p=("lat", "lon"))
    return found.select("tid", "seq", F.round("metres", 3).alias("metres"), F.round("nearest_lat", 5).alias("nearest_lat"), F.round("nearest_lon", 5).alias("nearest_lon"))


@query(f"""WITH {t.EVENTS}, m AS (SELECT min(y) AS lo, max(y) AS hi FROM p) SELECT tid, seq, CAST(floor(least(greatest((y - lo) / (hi - lo), 0), 1) * 1023) AS BIGINT) AS colour FROM p, m""")
def scaled_colour(spark, sf_dir):
    rows = resample.scaled(t.events(spark, sf_dir), "y", "part")
    return rows.select("tid", "seq", F.floor(F.col("part") * 1023).alias("colour"))
