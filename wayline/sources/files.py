"""Text formats of trajectories. Spark splits files into lines wherever it likes; the order of lines is their place in the file.

A file of any size is read by as many tasks as it has splits. A line's number comes from its place in
its split and the counts of the splits before; trajectories are numbered by a scan over ranges of
(path, place). Compressed files are one split each.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import number_runs


def _lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, place, line): the lines of every file with their numbers in it, from 0; blank lines count and are left out."""
    read = spark.read.options(lineSep="\n", **options).text(path)
    rows = read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"), F.regexp_replace("value", "\r$", "").alias("line"),
    )
    # the rows of a split stand in one task one after another, so their numbers there are consecutive
    splits = rows.groupBy("path", "_start").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("_start")
    splits = splits.select("path", "_start", "_first", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    found = rows.join(splits, ["path", "_start"]).select("path", (F.col("_row") - F.col("_first") + F.col("_before")).alias("place"), "line")
    return found.where(F.trim("line") != "")


def _words(line="line"):
    return F.split(F.trim(line), r"\s+")


def count_words(line: Column) -> Column:
    """How many words, parted by white space, a line has; none where it is blank or null."""
    return F.when(F.coalesce(F.trim(line), F.lit("")) == "", 0).otherwise(F.size(_words(line)))


def _by_consecutive_id(rows: DataFrame, drop_boundary: bool) -> DataFrame:
    """rows with tid and seq: a trajectory begins with a file, and where the id changes."""
    fresh = lambda before: before.isNull() | (before["path"] != F.col("path")) | (before["id"] != F.col("id"))
    runs = number_runs(rows, ["path", "place"], fresh, ["path", "id"], run="tid", place="seq")
    if not drop_boundary:
        return runs
    # the row on which the id changes is lost, the first of a file is not; what is left is numbered again
    opens = runs.groupBy("path").agg(F.min("tid").alias("_opens"))
    kept = runs.join(opens, "path").where((F.col("seq") > 0) | (F.col("tid") == F.col("_opens"))).drop("_opens", "seq").withColumnRenamed("tid", "_of")
    again = lambda before: before.isNull() | (before["_of"] != F.col("_of"))
    return number_runs(kept, ["path", "place"], again, ["_of"], run="tid", place="seq").drop("_of")


def read_xyi(spark: SparkSession, path: str, drop_boundary: bool = False) -> DataFrame:
    """(tid, seq, x, y, id) of space-separated `x y id` lines; a new trajectory begins where the whole part of the id changes."""
    w = _words()
    rows = _lines(spark, path).select("path", "place", F.get(w, 0).cast("double").alias("x"), F.get(w, 1).cast("double").alias("y"), F.get(w, 2).cast("double").cast("long").alias("id"))
    return _by_consecutive_id(rows, drop_boundary).select("tid", "seq", "x", "y", "id")


#: The other name under which this format is known.
read_roma = read_xyi


def read_segments(spark: SparkSession, path: str, drop_boundary: bool = False) -> DataFrame:
    """(tid, seq, x1, y1, x2, y2, id) of space-separated `x y x2 y2 id` lines."""
    w = _words()
    names = ("x1", "y1", "x2", "y2")
    rows = _lines(spark, path).select("path", "place", *(F.get(w, i).cast("double").alias(n) for i, n in enumerate(names)), F.get(w, 4).cast("double").cast("long").alias("id"))
    return _by_consecutive_id(rows, drop_boundary).select("tid", "seq", *names, "id")


def read_plt(spark: SparkSession, base: str, most_folders: int = 200) -> DataFrame:
    """(tid, seq, lat, lon, alt, days, t) of GPS logs: folders `Data/000/Trajectory` and on, six lines of header, then comma-separated rows.

    Files whose name begins with a dot, empty files and files with a row that cannot be read are left out.
    """
    rows = _lines(spark, f"{base}/Data/*/Trajectory", pathGlobFilter="*.plt")
    folder = F.regexp_extract("path", r"/Data/(\d{3})/Trajectory/", 1)
    rows = rows.where((F.col("place") >= 6) & (folder != "") & (F.try_to_number(folder, F.lit("999")) < most_folders) & ~F.col("path").rlike(r"/\.[^/]*$"))
    w = F.split("line", ",")
    number = lambda i: F.trim(F.get(w, i)).try_cast("double")
    read = rows.select("path", "place", number(0).alias("lat"), number(1).alias("lon"), number(3).alias("alt"), number(4).alias("days"))
    broken = read.where("lat IS NULL OR lon IS NULL OR alt IS NULL OR days IS NULL").select("path").distinct()
    fine = read.join(broken, "path", "left_anti")
    return _numbered(fine).withColumn("t", F.timestamp_micros(F.round((F.col("days") - 25569) * 86400 * 1_000_000).cast("long"))).select("tid", "seq", "lat", "lon", "alt", "days", "t")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(tid, seq, values) of a folder: a file for each trajectory, in order of names; as many columns as the file's first line has."""
    rows = _lines(spark, path).where(~F.col("path").rlike(r"/\.[^/]*$"))
    values = F.transform(_words(), lambda v: v.try_cast("double"))
    width = rows.groupBy("path").agg(F.size(F.min_by(_words(), "place")).alias("width"))
    cut = rows.join(width, "path").select("path", "place", F.slice(values, F.lit(1), F.greatest("width", F.lit(1))).alias("values"))
    return _numbered(cut).select("tid", "seq", "values")


def _numbered(rows: DataFrame) -> DataFrame:
    """tid by the order of paths, seq by the order of lines."""
    return number_runs(rows, ["path", "place"], lambda before: before.isNull() | (before["path"] != F.col("path")), ["path"], run="tid", place="seq")


def write_clusters(segments: DataFrame, path: str) -> None:
    """Segments with their clusters as space-separated text with a header, sixteen decimals."""
    number = lambda c: F.format_string("%.16f", F.col(c).cast("double")).alias(c)
    rows = segments.select(*(number(c) for c in ("x1", "y1", "x2", "y2")), "trajectory_index", "cluster")
    rows.write.option("sep", " ").option("header", True).option("quote", "").csv(path)


def write_xyi(points: DataFrame, path: str) -> None:
    """`x y id` lines of (tid, seq, x, y): files in order of tid, every trajectory in one of them."""
    _write_lines(points.select("tid", "seq", F.concat_ws(" ", *(F.col(c).cast("string") for c in ("x", "y", "tid"))).alias("value")), path)


def write_segments(segments: DataFrame, path: str) -> None:
    """`x y x2 y2 id` lines of (tid, seq, x1, y1, x2, y2), as write_xyi() has them."""
    _write_lines(segments.select("tid", "seq", F.concat_ws(" ", *(F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2", "tid"))).alias("value")), path)


def _write_lines(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("tid").sortWithinPartitions("tid", "seq").select("value").write.text(path)


def write_directory(points: DataFrame, path: str, *columns: str) -> None:
    """A folder `trajectory=<tid>` with one file of white-space separated columns for every trajectory."""
    lines = points.select(F.col("tid").alias("trajectory"), "seq", F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("value"))
    lines.repartition("trajectory").sortWithinPartitions("trajectory", "seq").drop("seq").write.partitionBy("trajectory").text(path)


def write_points(points: DataFrame, path: str) -> None:
    """Point tables as Parquet, sorted by (tid, seq) over all files; a long trajectory may go on in the next file."""
    points.repartitionByRange("tid", "seq").sortWithinPartitions("tid", "seq").write.parquet(path)
