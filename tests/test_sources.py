"""Readers that split files, and counts that run over ranges, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from wayline.operators import points as pt
from wayline.operators import scan
from wayline.sources import files


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def loop(lines_of_files, drop):
    """(tid, seq, x, id) by reading one line after another."""
    out, tid = [], -1
    for lines in lines_of_files:
        rows = [(float(a), int(float(c))) for a, _, c in (x.split() for x in lines if x.strip())]
        runs = []
        for i, (x, own) in enumerate(rows):
            if i == 0 or rows[i - 1][1] != own:
                runs.append([])
                if drop and i:
                    continue
            runs[-1].append((x, own))
        for run in runs:
            if run:
                tid += 1
                out += [(tid, k, x, own) for k, (x, own) in enumerate(run)]
    return out


@pytest.mark.parametrize("drop", [False, True])
def test_split_files_equal_a_plain_loop(spark, tmp_path, small_splits, drop):
    rng, made = random.Random(4), []
    for name in ("a.xyi", "b.xyi", "c.xyi"):
        lines, own = [], 1
        for i in range(3000 if name == "a.xyi" else 40):
            if rng.random() < 0.02:
                own = rng.randrange(5)
            lines.append("" if rng.random() < 0.05 else f"{i}  {i / 2} {own}.0")
        (tmp_path / name).write_text("\r\n".join(lines) + "\n", newline="")
        made.append(lines)
    read = spark.read.text(str(tmp_path))
    assert read.rdd.getNumPartitions() > 8
    found = files.read_xyi(spark, str(tmp_path), drop_boundary=drop)
    assert sorted((r.tid, r.seq, r.x, r.id) for r in found.collect()) == loop(made, drop)


def test_numbers_of_lines(spark, tmp_path, small_splits):
    lines = [f"line {i}" if i % 7 else "" for i in range(5000)]
    (tmp_path / "x.txt").write_text("\n".join(lines))
    got = {r.place: r.line for r in files._lines(spark, str(tmp_path)).collect()}
    assert got == {i: x for i, x in enumerate(lines) if x}


def test_segments_directories_and_sinks(spark, tmp_path):
    points = spark.createDataFrame([(t, i, float(i), float(t) / 3) for t in (3, 1, 20) for i in range(5)], "tid long, seq long, x double, y double")
    files.write_xyi(points, str(tmp_path / "xyi"))
    got = sorted((r.tid, r.seq, r.x, r.y, r.id) for r in files.read_roma(spark, str(tmp_path / "xyi")).collect())
    assert got == [(k, i, float(i), t / 3, t) for k, t in enumerate((1, 3, 20)) for i in range(5)]
    files.write_directory(points, str(tmp_path / "folder"), "x", "y")
    got = sorted((r.tid, r.seq, tuple(r["values"])) for r in files.read_directory(spark, str(tmp_path / "folder/*")).collect())
    assert got == [(k, i, (float(i), t / 3)) for k, t in enumerate((1, 20, 3)) for i in range(5)]
    segs = points.select("tid", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 1).alias("x2"), F.col("y").alias("y2"))
    files.write_segments(segs, str(tmp_path / "segs"))
    got = files.read_segments(spark, str(tmp_path / "segs"))
    assert got.count() == 15 and got.agg(F.max("tid"), F.max("seq"), F.sum(F.col("x2") - F.col("x1"))).first()[:] == (2, 4, 15.0)
    files.write_points(points, str(tmp_path / "points"))
    assert sorted(spark.read.parquet(str(tmp_path / "points")).collect()) == sorted(points.collect())
    clusters = segs.withColumn("trajectory_index", F.col("tid")).withColumn("cluster", F.lit(-2))
    files.write_clusters(clusters, str(tmp_path / "clusters"))
    lines = [x for f in (tmp_path / "clusters").glob("*.csv") for x in f.read_text().splitlines()]
    assert "x1 y1 x2 y2 trajectory_index cluster" in lines and "0.0000000000000000 1.0000000000000000 1.0000000000000000 1.0000000000000000 3 -2" in lines


def test_a_file_with_fewer_or_odd_columns(spark, tmp_path):
    (tmp_path / "a").write_text("1 2\n3 4 5\nx 6\n")
    (tmp_path / ".hidden").write_text("9 9\n")
    got = [(r.tid, r.seq, r["values"]) for r in files.read_directory(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [(0, 0, [1.0, 2.0]), (0, 1, [3.0, 4.0]), (0, 2, [None, 6.0])]


def test_words_of_a_line(spark):
    lines = [("a  b\tc ",), ("",), ("   ",), (None,), ("x",)]
    assert [r[0] for r in spark.createDataFrame(lines, "v string").select(files.count_words(F.col("v"))).collect()] == [3, 0, 0, 0, 1]


def test_ranges_of_a_skewed_order_are_even(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 19_000, F.col("id")).otherwise(F.col("id") * 10**9).alias("seq"))
    sizes = [r[0] for r in scan.ranges(rows, ["seq"], 16).groupBy("_block").count().select("count").collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_runs_equal_a_plain_loop(spark, blocks):
    rng = random.Random(blocks)
    rows = [(rng.randrange(10**9) if i % 50 else -i, rng.random() < 0.03) for i in range(1500)]
    df = spark.createDataFrame(sorted(set(rows)), "at long, opens boolean")
    wanted, run, place = [], -1, None
    for at, opens in sorted(set(rows)):
        run, place = (run + 1, 0) if opens else (run, place if place is None else place + 1)
        wanted.append((at, opens, run, place))
    found = scan.number_runs(df, ["at", "opens"], lambda _: F.col("opens"), blocks=blocks)
    assert sorted(map(tuple, found.select("at", "opens", "_run", "_place").collect())) == wanted
    assert scan.number_runs(df.limit(0), ["at"], lambda _: F.col("opens")).count() == 0


def test_numbering_a_table_uses_no_single_task_window(spark):
    rows = spark.range(1000).select(F.col("id").alias("seq"), F.when(F.col("id") % 9 > 0, F.col("id").cast("double")).alias("x"))
    plan = pt.trajectory_ids(rows)._jdf.queryExecution().executedPlan().toString()
    # windows without a key see one row for each range, never rows of the table
    assert plan.count("SinglePartition") <= 3
    assert sorted(r.rank for r in scan.ranks(rows.where("x IS NOT NULL"), "x").collect()) == list(range(rows.where("x IS NOT NULL").count()))
