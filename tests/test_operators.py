"""Operators that SQL cannot express, against plain loops, published values and bounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import geohash as gh
from wayline.functions import geometry as g
from wayline.functions import trajectories as tr
from wayline.operators import bloom, cluster, frechet, linear, lowrank, persistence, simplify, spec
from wayline.operators import points as pt
from wayline.plans import registry
from wayline.sources import files


def _curve(n, seed):
    return np.cumsum(np.random.default_rng(seed).normal(size=(n, 2)), axis=0)


def _points(spark, curves):
    rows = [(tid, i, float(x), float(y)) for tid, p in enumerate(curves) for i, (x, y) in enumerate(p)]
    return spark.createDataFrame(rows, "tid long, seq long, x double, y double")


def test_geodesic_of_known_points(spark):
    """Two published lines: Flinders Peak to Buninyong, and a degree of longitude on the equator."""
    rows = spark.createDataFrame([(-37.95103342, 144.42486789, -37.65282114, 143.92649553), (0.0, 0.0, 0.0, 1.0), (10.0, 20.0, 10.0, 20.0)], "a double, b double, c double, d double")
    found = [r[0] for r in rows.select(g.geodesic(*(F.col(c) for c in "abcd"))).collect()]
    assert found[0] == pytest.approx(54972.271, abs=0.02)  # on the ellipsoid used here
    assert found[1] == pytest.approx(111319.491, abs=0.01)
    assert found[2] == 0


def test_geohash_of_published_points(spark):
    rows = spark.createDataFrame([(57.64911, 10.40744), (-25.382708, -49.265506)], "lat double, lon double")
    assert rows.select(gh.encode(F.col("lat"), F.col("lon"), 11)).first()[0] == "u4pruydqqvj"
    assert [r[0] for r in rows.select(gh.encode(F.col("lat"), F.col("lon"), 8)).collect()][1] == "6gkzwgjz"


def test_murmur_of_nothing_and_its_spread():
    assert bloom.murmur128(b"", 0) == (0, 0, 0, 0)
    assert len({bloom.murmur128(f"{i}".encode(), 42) for i in range(2000)}) == 2000


def test_opening_window_keeps_every_point_near():
    p = _curve(200, 1)
    keep = np.flatnonzero(simplify.window_vertices(p, 1.5))
    assert keep[0] == 0 and keep[-1] == 199
    for a, b in zip(keep[:-1], keep[1:]):
        assert b - a < 2 or b == 199 or simplify.distance_to_segment(p[a + 1 : b], p[a], p[b]).max() <= 1.5


def test_persistence_bars_of_a_known_curve():
    bars, _ = persistence.pairing([0, 9, 0, -7, -2, -3, 6, -2, 1, 0])
    assert bars == [(5, 4), (7, 6), (9, 8), (3, 1)]


def test_pruning_keeps_ends_and_fewer_points_for_larger_beta(spark):
    rows = _points(spark, [_curve(120, 2), _curve(2, 3), _curve(1, 4)])
    sizes = [dict((r[0], r[1]) for r in persistence.pruned(rows, b).groupBy("tid").count().collect()) for b in (0.0, 60.0, 400.0)]
    assert sizes[0][0] >= sizes[1][0] >= sizes[2][0] == 2
    assert sizes[2][1] == 2 and sizes[2][2] == 1


def test_continuous_frechet_against_its_bounds():
    for seed in range(5):
        u, v = _curve(15, seed), _curve(12, seed + 50)
        d = np.sqrt(((u[:, None] - v[None]) ** 2).sum(axis=2))
        low = max(d[0, 0], d[-1, -1])
        table = np.full(d.shape, np.inf)
        for i in range(len(u)):
            for j in range(len(v)):
                before = 0 if i == j == 0 else min(table[i - 1, j] if i else np.inf, table[i, j - 1] if j else np.inf, table[i - 1, j - 1] if i and j else np.inf)
                table[i, j] = max(before, d[i, j])
        found = frechet.bisect(u, v, 1e-6)
        assert low - 1e-9 <= found <= table[-1, -1] + 1e-6
        assert frechet.decide(u, v, found) and (found == low or not frechet.decide(u, v, found - 1e-3))


def test_banded_warping_against_a_table(spark):
    a, b = _curve(9, 5), _curve(11, 6)
    rows = pt.pack(_points(spark, [a, b]))
    one = rows.where("tid = 0").select(F.col("pts").alias("u")).crossJoin(rows.where("tid = 1").select(F.col("pts").alias("v")))
    found = one.select(tr.dtw_banded(F.col("u"), F.col("v"), 3)).first()[0]
    table = np.full((10, 12), np.inf)
    table[0, 0] = 0
    for i in range(9):
        for j in range(11):
            if abs(i - j) <= 3:
                table[i + 1, j + 1] = math.dist(a[i], b[j]) + min(table[i, j], table[i, j + 1], table[i + 1, j])
    assert found == pytest.approx(table[-1, -1])


def _plain_distance(candidate, other):
    def total(s, o):
        (x1, y1, x2, y2), n = s, math.dist(s[:2], s[2:])
        feet, off = [], []
        for p in (o[:2], o[2:]):
            t = ((p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)) / n**2 if n else 0
            foot = (x1 + t * (x2 - x1), y1 + t * (y2 - y1))
            off.append(math.dist(p, foot))
            feet += [math.dist(foot, s[:2]), math.dist(foot, s[2:])]
        turn = math.atan2(o[3] - o[1], o[2] - o[0]) - math.atan2(y2 - y1, x2 - x1)
        across = (off[0] ** 2 + off[1] ** 2) / sum(off) if sum(off) >= 1e-4 else 0
        return 0.33 * across + 0.33 * min(feet) + 0.33 * math.dist(o[:2], o[2:]) * abs(math.sin(turn))

    longer = math.dist(candidate[:2], candidate[2:]) >= math.dist(other[:2], other[2:])
    return total(candidate, other) if longer else total(other, candidate)


def test_near_segments_and_labels_against_loops(spark):
    rng = np.random.default_rng(8)
    ends = rng.uniform(0, 12, (150, 2))
    segs = [(i, i % 7, *map(float, (*p, *(p + rng.normal(0, 1, 2))))) for i, p in enumerate(ends)]
    segs.append((150, 3, 1.0, 1.0, 1.0, 1.0))
    rows = spark.createDataFrame(segs, "sid long, trajectory_index long, x1 double, y1 double, x2 double, y2 double")
    found = {tuple(r) for r in cluster.near_pairs(rows, 0.6).collect()}
    wanted = {(a[0], b[0]) for a in segs for b in segs if a[0] != b[0] and _plain_distance(b[2:], a[2:]) <= 0.6}
    assert found == wanted and wanted

    labels = {r.sid: r.cluster for r in cluster.labelled(rows, 0.6, 4).collect()}
    near = {s[0]: sorted(b for a, b in wanted if a == s[0]) for s in segs}
    core = {s for s in near if len(near[s]) + 1 >= 4}
    comp = {}
    for s in sorted(core):
        if s not in comp:
            todo = [s]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = s
                    todo += [y for y in near[x] if y in core]
    rank = {seed: n for n, seed in enumerate(sorted(set(comp.values())))}
    told = {}
    for s in near:
        around = [c for c in near[s] if c in core]
        told[s] = rank[comp[s]] if s in core else max([min(rank[comp[c]] for c in around), *(rank[c] for c in around if comp[c] == c)]) if around else -2
    sources = {c: {t for s, t, *_ in segs if told[s] == c} for c in set(told.values())}
    assert labels == {s: -3 if c >= 0 and len(sources[c]) < 4 else c for s, c in told.items()}


#: The first points of a published sample, and the segments published for them.
SAMPLE = [
    (200, 1552), (201.07, 1552.01), (203.84, 1552.02), (209.24, 1552.03), (215.54, 1552.04), (224.44, 1552.05), (233.04, 1552.06), (243.88, 1551.91), (251.96, 1551.24),
    (263.27, 1548.95), (271.04, 1546.21), (281.28, 1541.22), (289.46, 1536.04), (299.78, 1528.16), (305.98, 1522.73), (311.98, 1517), (320.06, 1508.64), (326.69, 1501.17),
    (334.33, 1492.11), (339.8, 1485.38), (348.54, 1474.33), (354.02, 1467.43), (361.61, 1457.71), (366.99, 1450.72), (374.39, 1440.73), (381.34, 1430.03), (386.43, 1420.3),
]
PUBLISHED = [(200, 1552), (243.88, 1551.91), (251.96, 1551.24), (263.27, 1548.95), (271.04, 1546.21), (281.28, 1541.22), (299.78, 1528.16), (311.98, 1517), (326.69, 1501.17), (361.61, 1457.71)]


def test_published_segments(spark):
    points = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(SAMPLE)], "tid long, seq long, x double, y double")
    rows = cluster.traclus(points, 25, 1).orderBy("sid").collect()
    assert [(r.x1, r.y1, r.x2, r.y2) for r in rows][:9] == [(*map(float, a), *map(float, b)) for a, b in zip(PUBLISHED, PUBLISHED[1:])]
    assert {r.cluster for r in rows[:9]} == {0}


def test_cut_and_distance_of_ones_own(spark):
    rng = np.random.default_rng(3)
    curves = [np.cumsum(rng.normal(0, 1, (30, 2)), axis=0) for _ in range(4)]
    middles = lambda s, o: np.hypot((s.x1 + s.x2 - o.x1 - o.x2) / 2, (s.y1 + s.y2 - o.y1 - o.y2) / 2)
    every_third = lambda p: [*range(0, len(p) - 1, 3), len(p) - 1]
    segs = cluster.segments(_points(spark, curves), every_third)
    rows = segs.collect()
    assert len(rows) == 4 * 10
    longest = max(math.dist((r.x1, r.y1), (r.x2, r.y2)) for r in rows)
    found = {tuple(r) for r in cluster.near_pairs(segs, 0.8, distance=middles, reach=0.8 + longest).collect()}
    middle = {r.sid: ((r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2) for r in rows}
    assert found == {(a, b) for a in middle for b in middle if a != b and math.dist(middle[a], middle[b]) <= 0.8} and found
    labels = cluster.traclus(_points(spark, curves), 0.8, 2, places=every_third, distance=middles, reach=0.8 + longest).collect()
    assert len(labels) == len(rows) and {r.cluster for r in labels} > {-2}


def test_crowded_cells_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 16)
    rng = np.random.default_rng(5)
    segs = [(i, i, *map(float, rng.uniform(0, 3, 4))) for i in range(120)] + [(120 + i, i, 1.0, 1.0, 2.0, 2.0) for i in range(20)]
    rows = spark.createDataFrame(segs, "sid long, trajectory_index long, x1 double, y1 double, x2 double, y2 double")
    found = [tuple(r) for r in cluster.near_pairs(rows, 0.3).collect()]
    assert sorted(found) == sorted((a[0], b[0]) for a in segs for b in segs if a[0] != b[0] and _plain_distance(b[2:], a[2:]) <= 0.3)
    assert cluster.near_pairs(rows.limit(0), 0.3).count() == 0


def test_segments_cover_each_trajectory(spark):
    curves = [_curve(60, 9), _curve(2, 10), _curve(1, 11)]
    found = cluster.segments(_points(spark, curves)).orderBy("sid").collect()
    for tid, p in enumerate(curves):
        mine = [r for r in found if r.trajectory_index == tid]
        assert (mine[0].x1, mine[0].y1) == tuple(p[0]) and (mine[-1].x2, mine[-1].y2) == tuple(p[-1])
        assert all((a.x2, a.y2) == (b.x1, b.y1) for a, b in zip(mine, mine[1:]))


def test_singular_values_against_a_whole_decomposition(spark):
    a = np.random.default_rng(12).normal(size=(80, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, v array<double>")
    values, vectors = linear.decompose(rows, "v", 3)
    assert values == pytest.approx(np.linalg.svd(a, compute_uv=False)[:3])
    assert np.abs(vectors.T @ vectors - np.eye(3)).max() < 1e-9


def test_leaders_against_one_pass(spark, sf_dir):
    found = {r.tid: r.leader for r in registry.QUERIES["leader_classes"](spark, sf_dir).collect()}
    from wayline.operators import index
    from wayline.plans import tables

    bits = {r.tid: set(r.bits) for r in bloom.filters(index.cell_sets(tables.events(spark, sf_dir), 1), 64, 2).collect()}
    leaders, wanted = [], {}
    for tid in sorted(bits):
        wanted[tid] = next((x for x in leaders if len(bits[x] ^ bits[tid]) < 14), tid)
        leaders += [tid] * (wanted[tid] == tid)
    assert found == wanted


def test_randomised_decomposition_of_many_columns(spark):
    rng = np.random.default_rng(14)
    a = (rng.normal(size=(300, 8)) * 2.0 ** -np.arange(8)) @ rng.normal(size=(8, 5000)) + 1e-3 * rng.normal(size=(300, 5000))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)] + [(-1, None)], "id long, v array<double>").repartition(6)
    left, values, right = lowrank.randomised_svd(rows, "id", "v", 4)
    u, d, vt = np.linalg.svd(a, full_matrices=False)
    assert values == pytest.approx(d[:4], rel=1e-8)
    assert np.abs(np.abs((vt[:4] @ right)) - np.eye(4)).max() < 1e-6 and (right[np.abs(right).argmax(axis=0), range(4)] > 0).all()
    got = {r.id: r.scores for r in left.collect()}
    mine = np.array([got[i] for i in range(300)])
    assert len(got) == 300 and np.abs(np.abs(u[:, :4].T @ mine) - np.eye(4)).max() < 1e-6
    assert np.abs(mine * values @ right.T - (u[:, :4] * d[:4]) @ vt[:4]).max() < 1e-6


def test_randomised_decomposition_of_low_rank_and_none(spark):
    a = np.outer(np.arange(1.0, 21), np.ones(6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, v array<double>")
    left, values, right = lowrank.randomised_svd(rows, "id", "v", 3)
    assert values == pytest.approx([np.linalg.norm(a), 0, 0], abs=1e-9) and np.abs(right[:, 0] - 6**-0.5).max() < 1e-9
    left, values, right = lowrank.randomised_svd(rows.limit(0), "id", "v", 3)
    assert left.count() == 0 and len(values) == 0


def test_truncated_decomposition(spark):
    a = np.random.default_rng(15).normal(size=(50, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, v array<double>")
    left, values, right = linear.truncated_svd(rows, "id", "v", 6)
    got = {r.id: r.scores for r in left.collect()}
    assert np.abs(np.array([got[i] for i in range(50)]) * values @ right.T - a).max() < 1e-8


def test_specification_survives_xml():
    made = spec.group(spec.distance("dtw"), spec.distance("edit_distance", "length", length=1), id="g")
    assert spec.DistanceSpec.from_xml(made.to_xml()) == made


def test_readers(spark, tmp_path):
    (tmp_path / "a.xyi").write_text("0 0 5\n1 1 5\n2 2 7\n3 3 7\n4 4 5\n")
    every = files.read_xyi(spark, str(tmp_path / "a.xyi")).orderBy("tid", "seq").collect()
    assert [(r.tid, r.seq, r.x, r.id) for r in every] == [(0, 0, 0.0, 5), (0, 1, 1.0, 5), (1, 0, 2.0, 7), (1, 1, 3.0, 7), (2, 0, 4.0, 5)]
    assert files.read_xyi(spark, str(tmp_path / "a.xyi"), drop_boundary=True).count() == 3
    logs = tmp_path / "logs/Data/000/Trajectory"
    logs.mkdir(parents=True)
    (logs / "1.plt").write_text("h\n" * 6 + "39.9,116.3,0,492,25569.5,1970-01-01,12:00:00\n")
    (logs / "2.plt").write_text("h\n" * 6 + "39.9,oops,0,492,25569.5,1970-01-01,12:00:00\n")
    found = files.read_plt(spark, str(tmp_path / "logs")).collect()
    assert [(r.tid, r.lat, r.alt) for r in found] == [(0, 39.9, 492.0)]


def test_separated_tables_with_odd_separators(spark):
    """Leading, doubled and trailing separators, null and NaN."""
    nan = float("nan")
    xs = [nan, 1.0, 2.0, None, nan, 3.0, None]
    rows = spark.createDataFrame(list(enumerate(xs)), "seq long, x double")
    assert [r.tid for r in pt.trajectory_ids(rows, blocks=3).orderBy("seq").collect()] == [None, 1, 1, None, None, 2, None]


def test_without_points(spark):
    none = spark.createDataFrame([], "tid long, seq long, x double, y double")
    assert pt.pack(none).count() == 0
    assert simplify.douglas_peucker(none, 1.0).count() == 0
    assert persistence.pruned(none, 1.0).count() == 0
    assert cluster.segments(none).count() == 0


def _filled(values, rng):
    """Pairs by the definition, point by point: any stretch, in any order, takes its lower neighbour until it meets a maximum."""
    lows, highs = persistence.extrema(values)
    stretches = [[low, low, low] for low in lows]  # left, right, minimum
    met, bars = {}, set()
    while stretches:
        c = stretches[int(rng.integers(len(stretches)))]
        if c[0] == 0 and c[1] == len(values) - 1:
            stretches.remove(c)
            continue
        left = c[0] > 0 and (c[1] == len(values) - 1 or values[c[0] - 1] < values[c[1] + 1])
        c[0], c[1] = (c[0] - 1, c[1]) if left else (c[0], c[1] + 1)
        place = c[0] if left else c[1]
        if place in highs:
            stretches.remove(c)
            if place in met:
                other = met[place]
                bars.discard((other[2], place))
                bars.add((max(c[2], other[2]), place))
                stretches.append([min(c[0], other[0]), max(c[1], other[1]), min(c[2], other[2])])
            else:
                met[place] = c
                bars.add((c[2], place))
    return bars


def test_persistence_equals_filling_point_by_point():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(4, 30))
        values = rng.integers(0, 12, n).astype(float) if rng.random() < 0.5 else rng.normal(size=n)
        steps = np.sign(np.diff(values))
        if (steps >= 0).all() or (steps <= 0).all():
            continue
        assert set(persistence.pairing(values)[0]) == _filled(values, rng)


def test_thinning_equals_plain_loops():
    rng = np.random.default_rng(5)
    for _ in range(200):
        p = _curve(int(rng.integers(3, 60)), int(rng.integers(1 << 30)))
        values = persistence.turning_angles(p)
        places = list(range(len(p)))
        out = [0]
        for i in range(1, len(p) - 1):
            if np.hypot(*(p[i] - p[i + 1])) >= 1.2:
                out.append(i)
            elif not values[i] < values[i + 1]:
                out.append(i + 1)
            elif out[-1] != i:
                out.append(i)
        assert persistence.thin_by_distance(places, values, p, 1.2).tolist() == out + [len(p) - 1]
        kept = persistence.kept_places(values, 20.0)
        out, i = [kept[0]], 1
        while i < len(kept) - 1:
            near = simplify.distance_to_segment(p[kept[i] : kept[i] + 1], p[out[-1]], p[kept[i + 1]])[0] < 0.8
            out.append(kept[i + 1] if near else kept[i])
            i += 2 if near else 1
        assert persistence.segment_distance(p, 20.0, 0.8, 1).tolist() == out + [kept[-1]]


def test_curves_stretches_and_resolutions_as_tables(spark):
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 9, 0, -7, -2, -3, 6, -2, 1, 0])], "tid long, seq long, value double")
    assert sorted(map(tuple, persistence.curve_bars(rows).select("low", "high").collect())) == [(3, 1), (5, 4), (7, 6), (9, 8)]
    assert {r.low for r in persistence.curve_stretches(rows).collect()} == {0, 3, 5, 7, 9}
    p = _curve(80, 1)
    got = persistence.multi_resolution_places(_points(spark, [p]), 20.0, 3).orderBy("n").collect()
    assert [r.seq for r in got] == persistence.multi_resolution(p, 20.0, 3).tolist()


def test_opening_window_equals_one_end_at_a_time():
    rng = np.random.default_rng(9)
    for _ in range(200):
        p = _curve(int(rng.integers(0, 120)), int(rng.integers(1 << 30))) if rng.random() < 0.8 else np.zeros((30, 2))
        keep = {0, len(p) - 1} if len(p) else set()
        start, end = 0, 2
        while end < len(p):
            far = [i for i in range(start + 1, end) if simplify.distance_to_segment(p[i : i + 1], p[start], p[end])[0] > 1.5]
            start, end = (far[0], far[0] + 2) if far else (start, end + 1)
            keep |= {start}
        assert set(np.flatnonzero(simplify.window_vertices(p, 1.5))) == keep


def test_murmur_against_published_values():
    assert bloom.murmur128(b"", 1) == (0x88C4ADEC, 0x54D201B9, 0x54D201B9, 0x54D201B9)
    assert bloom.murmur32(b"", 1) == 0x514E28B7 and bloom.murmur32(b"test", 0) == 0xBA6BD213
    assert bloom.murmur32(b"Hello, world!", 0) == 0xC0363E43


def test_geohash_takes_either_order(spark):
    row = spark.createDataFrame([(57.64911, 10.40744)], "lat double, lon double")
    both = row.select(gh.encode_pair(F.col("lon"), F.col("lat"), 11), gh.encode_pair(F.col("lat"), F.col("lon"), 11, "latlon")).first()
    assert both[0] == both[1] == "u4pruydqqvj"
    with pytest.raises(ValueError):
        gh.encode_pair(F.col("lat"), F.col("lon"), 11, "latlng")
