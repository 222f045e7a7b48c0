"""Queries on simplification."""

from ..operators import persistence, simplify
from . import tables as t
from .registry import query, r6
from pyspark.sql import functions as F

EPS = 12.0

_CHORD = "CASE WHEN (b.x - a.x) ** 2 + (b.y - a.y) ** 2 < 1e-12 THEN sqrt((p.x - a.x) ** 2 + (p.y - a.y) ** 2) ELSE sqrt((p.x - a.x - f * (b.x - a.x)) ** 2 + (p.y - a.y - f * (b.y - a.y)) ** 2) END"
_SPLIT = f"""WITH RECURSIVE {t.SUPPLY}, r AS (
  SELECT tid, min(seq) AS lo, max(seq) AS hi, CAST(NULL AS BIGINT) AS k, CAST(0 AS DOUBLE) AS m FROM p GROUP BY tid
  UNION ALL
  SELECT tid, e[1], e[2], k, m FROM (
    SELECT tid, unnest([[lo, k], [k, hi]]) AS e, k, m FROM (
      SELECT tid, lo, hi, arg_min(seq, seq) FILTER (d = top) AS k, any_value(top) AS m FROM (
        SELECT *, max(d) OVER (PARTITION BY tid, lo, hi) AS top FROM (
          SELECT s.tid, s.lo, s.hi, s.seq, {_CHORD.replace('p.x', 's.x').replace('p.y', 's.y').replace('a.x', 's.ax').replace('a.y', 's.ay').replace('b.x', 's.bx').replace('b.y', 's.by')} AS d FROM (
            SELECT r.tid, r.lo, r.hi, p.seq, p.x, p.y, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by",
              least(greatest(((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)) / nullif((b.x - a.x) ** 2 + (b.y - a.y) ** 2, 0), 0), 1) AS f
            FROM r JOIN p ON p.tid = r.tid AND p.seq > r.lo AND p.seq < r.hi JOIN p a ON a.tid = r.tid AND a.seq = r.lo JOIN p b ON b.tid = r.tid AND b.seq = r.hi) s))
      GROUP BY tid, lo, hi) WHERE m > {EPS}))"""
_SPLIT = _SPLIT.replace("s.by", 's."by"')


@query(f"{_SPLIT}, w AS (SELECT tid, lo AS seq FROM r UNION SELECT tid, hi FROM r) SELECT p.tid, p.seq, p.y FROM p JOIN w USING (tid, seq)")
def douglas_peucker(spark, sf_dir):
    return simplify.douglas_peucker(t.supply(spark, sf_dir), EPS).select("tid", "seq", "y")


@query(f"{_SPLIT}, w AS (SELECT DISTINCT tid, k AS seq, m FROM r WHERE k IS NOT NULL) SELECT p.tid, p.seq, round(coalesce(m, 0), 6) AS weight FROM p LEFT JOIN w USING (tid, seq)")
def douglas_peucker_weights(spark, sf_dir):
    return simplify.douglas_peucker_weights(t.supply(spark, sf_dir), EPS).select("tid", "seq", r6(F.col("weight")).alias("weight"))


_LISTS = f"WITH RECURSIVE {t.SUPPLY}, l AS MATERIALIZED (SELECT tid, list(x ORDER BY seq) AS xs, list(y ORDER BY seq) AS ys, count(*) AS n FROM p GROUP BY tid)"
# the foot of point j on the chord of the window s..e, as a share of it; lists count from one
_ALONG = "CASE WHEN dx * dx + dy * dy < 1e-12 THEN 0 ELSE least(greatest(((xs[j + 1] - ax) * dx + (ys[j + 1] - ay) * dy) / (dx * dx + dy * dy), 0), 1) END"


@query(f"""{_LISTS}, g AS (
  SELECT tid, CAST(0 AS BIGINT) AS s, CAST(2 AS BIGINT) AS e, CAST(NULL AS BIGINT) AS kept FROM l
  UNION ALL
  SELECT tid, coalesce(k, s), CASE WHEN k IS NULL THEN e + 1 ELSE k + 2 END, k FROM (
    SELECT tid, s, e, list_min(list_filter(range(s + 1, e), lambda j: sqrt((xs[j + 1] - ax - ({_ALONG}) * dx) ** 2 + (ys[j + 1] - ay - ({_ALONG}) * dy) ** 2) > {EPS})) AS k FROM (
      SELECT g.*, xs, ys, xs[s + 1] AS ax, ys[s + 1] AS ay, xs[e + 1] - xs[s + 1] AS dx, ys[e + 1] - ys[s + 1] AS dy FROM g JOIN l USING (tid) WHERE e < n)))
SELECT p.tid, p.seq, p.y FROM p JOIN (SELECT tid, kept AS seq FROM g WHERE kept IS NOT NULL UNION SELECT tid, unnest([0, n - 1]) FROM l) USING (tid, seq)""")
def opening_window(spark, sf_dir):
    """Each trajectory by an opening window, one end after another."""
    return simplify.opening_window(t.supply(spark, sf_dir), EPS).select("tid", "seq", "y")


def _step(a, b):
    dx, dy = f"(xs[{b} + 1] - xs[{a} + 1])", f"(ys[{b} + 1] - ys[{a} + 1])"
    return f"sqrt({dx} ** 2 + {dy} ** 2) / ({b} - {a})", f"degrees(atan2({dy}, {dx}))"


def _foretold(a, b, slack=0.5, turn=60.0):
    (speed, heading), (v, h) = _step("(i - 1)", "i"), _step(a, b)
    off = f"({heading} - {h} + 180)"
    return f"({speed} BETWEEN {v} * {1 - slack} AND {v} * {1 + slack} AND abs({off} - 360 * floor({off} / 360) - 180) <= {turn})"


@query(f"""{_LISTS}, g AS (
  SELECT tid, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS b, CAST(1 AS BIGINT) AS c FROM l
  UNION ALL
  SELECT tid, i, CASE WHEN told THEN b ELSE c END, CASE WHEN told THEN c ELSE i END FROM (
    SELECT tid, i, b, c, {_foretold('(i - 2)', '(i - 1)')} AND {_foretold('b', 'c')} AS told FROM (SELECT tid, i + 1 AS i, b, c, xs, ys FROM g JOIN l USING (tid) WHERE i + 1 < n)))
SELECT p.tid, p.seq, p.y FROM p JOIN (SELECT tid, CAST(0 AS BIGINT) AS seq FROM l UNION SELECT tid, c FROM g) USING (tid, seq)""")
def threshold_sampling(spark, sf_dir):
    """Each supplier's points that speed and heading do not foretell, a second apart."""
    timed = t.supply(spark, sf_dir).withColumn("t", F.col("seq") * 1000)
    return simplify.threshold_sampling(timed, 0.5, 60.0).select("tid", "seq", "y")


_TURN = "degrees(acos(greatest(-1, least(1, ax / al * bx / bl + ay / al * b_y / bl)))) * CASE WHEN ax / al * b_y / bl - ay / al * bx / bl < 0 THEN -1 ELSE 1 END"


@query(f"""WITH {t.EVENTS}, s AS (
  SELECT tid, seq, count(*) OVER (PARTITION BY tid) AS n, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS b_y FROM p WINDOW w AS (PARTITION BY tid ORDER BY seq)
), l AS (SELECT *, sqrt(ax * ax + ay * ay) AS al, sqrt(bx * bx + b_y * b_y) AS bl FROM s), v AS (
  SELECT tid, seq, n, CASE WHEN al > 0 AND bl > 0 THEN {_TURN} ELSE 0 END AS v FROM l
), k AS (SELECT *, lead(v) OVER (PARTITION BY tid ORDER BY seq) AS next FROM v WHERE n > 2), e AS (
  SELECT tid, seq, n, v, lag(v) OVER w AS pv, lead(v) OVER w AS nv, count(*) OVER (PARTITION BY tid) AS levels FROM k WHERE next IS NULL OR next <> v WINDOW w AS (PARTITION BY tid ORDER BY seq)
)
SELECT tid, seq, CASE WHEN v < pv THEN 'min' ELSE 'max' END AS kind FROM e WHERE (v < pv) = (v < nv)
UNION ALL SELECT tid, 0, CASE WHEN nv > v THEN 'min' ELSE 'max' END FROM e WHERE levels > 1 AND pv IS NULL
UNION ALL SELECT tid, n - 1, CASE WHEN v > pv THEN 'max' ELSE 'min' END FROM e WHERE levels > 1 AND nv IS NULL
UNION ALL SELECT tid, unnest([0, n - 1]), unnest(['min', 'max']) FROM e WHERE levels = 1""")
def curve_extrema(spark, sf_dir):
    return persistence.marked_extrema(t.events(spark, sf_dir)).select("tid", "seq", "kind")


@query()
def persistence_bars(spark, sf_dir):
    return persistence.bars(t.events(spark, sf_dir))


@query()
def persistence_prune(spark, sf_dir):
    return persistence.pruned(t.events(spark, sf_dir), 30.0).select("tid", "seq", "y")


@query()
def persistence_mrs(spark, sf_dir):
    return persistence.pruned_multi_resolution(t.events(spark, sf_dir), 30.0, 5).select("tid", "seq", "y")


@query()
def persistence_sds(spark, sf_dir):
    return persistence.pruned_by_segments(t.events(spark, sf_dir), 30.0, 5.0, 5).select("tid", "seq", "y")
