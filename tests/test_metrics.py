"""Geodesics, metrics, sampling by speed, and functions for SQL, against published values, walks along lines and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import geodesic, metrics, sql
from wayline.functions import trajectories as tr
from wayline.operators import bloom, compare, frechet, simplify, spec
from wayline.operators import geodesic as lines
from wayline.plans import registry, tables


def test_geodesics_of_published_points():
    """Also two nearly antipodal pairs and two poles, of known length."""
    a, b, c, d = np.array([(-37.95103342, 144.42486789, -37.65282114, 143.92649553), (0, 0, 0, 1), (10, 20, 10, 20), (0, 0, 0.5, 179.5), (0, 0, 0.5, 179.7), (0, 0, 0, 180), (90, 0, -90, 0)], float).T
    found = geodesic.inverse(a, b, c, d)[0]
    assert found == pytest.approx([54972.271, 111319.491, 0, 19936288.579, 19944127.421, 20003931.459, 20003931.459], abs=0.001)


def test_lines_end_where_they_should():
    r = np.random.default_rng(2)
    lat1, lon1, lat2, lon2 = r.uniform(-90, 90, 500), r.uniform(-180, 180, 500), r.uniform(-90, 90, 500), r.uniform(-180, 180, 500)
    lat2[:3], lon2[:3] = -lat1[:3] + 0.01, lon1[:3] + 179.99
    _, azimuth, arc = geodesic.inverse(lat1, lon1, lat2, lon2)
    ends = geodesic.along(lat1, lon1, azimuth, arc)
    assert geodesic.inverse(*ends, lat2, lon2)[0].max() < 0.1


def test_distance_to_a_geodesic_segment(spark):
    r = np.random.default_rng(3)
    rows = [tuple(float(x) for x in (*r.uniform(-60, 60, 2), *r.uniform(-60, 60, 2), *r.uniform(-60, 60, 2))) for _ in range(20)]
    rows += [(10.0, 20.0, 10.0, 20.0, 11.0, 20.0), (0.0, 0.0, 0.0, 10.0, 1.0, 5.0), (0.0, 0.0, 0.0, 10.0, None, 5.0), (0.0, 0.0, 0.0, 10.0, math.nan, 5.0)]
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id long, ulat double, ulon double, vlat double, vlon double, plat double, plon double")
    found = {r.id: r for r in lines.segment_distances(table).collect()}
    for i, (ulat, ulon, vlat, vlon, plat, plon) in enumerate(rows[:-2]):
        _, azimuth, arc = (x[0] for x in geodesic.inverse([ulat], [ulon], [vlat], [vlon]))
        lat, lon = geodesic.along(ulat, ulon, azimuth, arc * np.linspace(0, 1, 20001))
        walked = geodesic.inverse(lat, lon, plat, plon)[0].min()
        assert found[i].metres == pytest.approx(walked, abs=1 + 1e-6 * walked)
        assert geodesic.inverse([found[i].nearest_lat], [found[i].nearest_lon], [plat], [plon])[0][0] == pytest.approx(found[i].metres, abs=0.01)
    assert [found[len(rows) - k].metres for k in (1, 2)] == [None, None]
    with pytest.raises(ValueError, match="metres"):
        lines.lengths(table.withColumn("metres", F.lit(1.0)), "ulat", "ulon", "vlat", "vlon")
    assert lines.lengths(table.limit(0), "ulat", "ulon", "vlat", "vlon").count() == 0


def test_every_distance_takes_a_metric(spark):
    u, v = [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], [(0.0, 1.0), (1.0, 2.0), (2.0, 4.0)]
    point = "struct<x: double, y: double>"
    rows = spark.createDataFrame([(1, u), (2, v), (3, [])], f"tid int, pts array<{point}>")
    asked = rows.where("tid = 1").selectExpr("tid AS query_tid", "pts AS query_pts")
    manhattan = metrics.Metric(lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"]))
    got = {r.tid: r for r in compare.distance_to(rows, asked, "closest_pair", "sum_of_pairs", "discrete_frechet", "discrete_hausdorff", metric=manhattan).collect()}
    assert (got[2].closest_pair, got[2].sum_of_pairs, got[2].discrete_frechet, got[2].discrete_hausdorff) == (1, 4, 2, 2)
    metres = {r.tid: r for r in compare.distance_to(rows.where("tid < 3"), asked, "sum_of_pairs", metric=metrics.GEODESIC).collect()}
    assert metres[2].sum_of_pairs == pytest.approx(sum(geodesic.inverse([a[0]], [a[1]], [b[0]], [b[1]])[0][0] for a, b in zip(u, v)), abs=0.01)
    with pytest.raises(ValueError, match="segment"):
        tr.point_to_trajectory(F.col("p"), F.col("pts"), metrics.GREAT_CIRCLE)
    assert rows.where("tid = 3").select(tr.nearest_or_infinite(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.col("pts"))).first()[0] == math.inf


def test_simplification_by_geodesics(spark):
    """A path along the equator with one point a hundredth of a degree off it, about 1,106 metres."""
    path = [(1, i, 0.01 if i == 5 else 0.0, i / 100) for i in range(11)]
    rows = spark.createDataFrame(path, "tid long, seq long, x double, y double")
    kept = lambda eps: {r.seq for r in simplify.douglas_peucker(rows, eps, metrics.GEODESIC).collect()}
    assert kept(1200.0) == {0, 10}
    assert 5 in kept(1000.0)


def _foretold(rows, slack, turn):
    """The points kept, one after another, with the two last kept remembered whole."""
    kept, out = rows[:2], [0, 1][: len(rows)]

    def motion(a, b):
        seconds = (b[2] - a[2]) / 1000
        return (math.dist(a[:2], b[:2]) / seconds if seconds else 0.0), math.degrees(math.atan2(b[1] - a[1], b[0] - a[0]))

    for i in range(2, len(rows)):
        v, h = motion(rows[i - 1], rows[i])
        fits = True
        for w, g in (motion(rows[i - 2], rows[i - 1]), motion(*kept[-2:])):
            off = abs(h - g) % 360
            fits &= w * (1 - slack) <= v <= w * (1 + slack) and min(off, 360 - off) <= turn
        if not fits:
            kept, out = [*kept, rows[i]], [*out, i]
    return out


def test_sampling_by_speed_equals_a_plain_loop(spark):
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 60):
        p = np.column_stack([np.cumsum(r.normal(1, 0.5, (n, 2)), axis=0), np.cumsum(r.integers(0, 4, n) * 500)])
        assert list(np.flatnonzero(simplify.surprising(p, 0.5, 40.0))) == _foretold([tuple(x) for x in p], 0.5, 40.0)
    steady = [(1, i, float(i), 0.0, 1000.0 * i) for i in range(9)] + [(1, 9, 9.0, 5.0, 9000.0)]
    rows = spark.createDataFrame(steady, "tid long, seq long, x double, y double, t double")
    assert sorted(r.seq for r in simplify.threshold_sampling(rows, 0.1, 10.0).collect()) == [0, 1, 9]


def test_frechet_with_the_largest_distance(spark, sf_dir):
    both = registry.QUERIES["frechet_and_largest"](spark, sf_dir).collect()
    alone = {r.tid: r.frechet for r in registry.QUERIES["frechet_continuous"](spark, sf_dir).collect()}
    assert {r.tid: r.frechet for r in both} == alone and all(r.largest >= r.frechet for r in both)
    point = "array<struct<x: double, y: double>>"
    rows = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0)], [(0.0, 3.0), (4.0, 3.0)]), (2, [], [(0.0, 0.0)])], f"id int, u {point}, v {point}")
    assert {r.id: (r.frechet, r.largest) for r in frechet.distances_and_largest(rows, "id").collect()} == {1: (3.0, 5.0), 2: (None, None)}


def test_specification_from_a_file(tmp_path):
    chosen = spec.group(spec.distance("dtw"), spec.distance("edit", "global", length=2), id="a")
    (tmp_path / "spec.xml").write_text(chosen.to_xml())
    assert spec.DistanceSpec.read(str(tmp_path / "spec.xml")) == chosen


def test_hash_of_64_bit_lanes_against_published_values(spark):
    assert bloom.murmur128_of_64(b"", 0) == (0, 0)
    assert bloom.murmur128_of_64(b"foo", 0) == ((-2129773440516405919) % 2**64, 9128664383759220103)
    assert bloom.murmur128_of_64(b"The quick brown fox jumps over the lazy dog", 0)[0] == 0xE34BBC7BBC071B6C
    row = spark.createDataFrame([("u4pr",), (None,)], "cell string").select(bloom.seeded_positions(F.col("cell"), 97, 3)).collect()
    assert row[0][0] == [bloom.murmur128(b"u4pr", i)[0] % 97 for i in range(3)] and row[1][0] is None


def test_functions_for_sql_equal_the_columns(spark, sf_dir):
    names = sql.register(spark)
    assert "traj_discrete_hausdorff" in names
    db = tables.vectors(spark, sf_dir).where("tid < 30")
    db.createOrReplaceTempView("paths")
    compared = ("closest_pair", "sum_of_pairs", "discrete_hausdorff", "dtw")
    called = [("traj_lockstep" if n == "dtw" else f"traj_{n}") + f"(a.pts, b.pts) AS {n}" for n in compared]
    got = spark.sql(f"SELECT b.tid, {', '.join(called)}, traj_trajectory_length(b.pts) AS length FROM paths a JOIN paths b ON a.tid = 1").collect()
    asked = db.where("tid = 1").selectExpr("tid AS query_tid", "pts AS query_pts")
    wanted = {r.tid: r for r in compare.distance_to(db, asked, *compared).collect()}
    assert len(got) == len(wanted) > 5
    for r in got:
        assert [r[n] for n in compared] == pytest.approx([wanted[r.tid][n] for n in compared])
    row = spark.sql("SELECT traj_haversine(0, 0, 0, 1) AS h, traj_closest_pair(array(), array()) AS c, traj_bits_jaccard(array(1, 2), array(2, 3)) AS j").first()
    assert row.h == pytest.approx(111195.08, abs=0.01) and row.c == 0 and row.j == pytest.approx(1 / 3)
