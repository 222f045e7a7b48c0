"""One trajectory against a database, pairs within groups, and specifications of several distances."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import PLANAR, Metric
from ..functions.trajectories import BY_NAME


def query_row(db: DataFrame, tid, most_points: int = 100_000) -> DataFrame:
    """(query_tid, query_pts): the one trajectory asked about, checked to be small enough to send to all tasks."""
    size = db.where(F.col("tid") == tid).agg(F.count("*"), F.max(F.size("pts"))).first()
    if size[0] != 1:
        raise ValueError(f"{size[0]} trajectories have the id {tid}")
    if size[1] > most_points:
        raise ValueError(f"a query of {size[1]} points is not sent to all tasks; simplify it first")
    return db.where(F.col("tid") == tid).select(F.col("tid").alias("query_tid"), F.col("pts").alias("query_pts")).limit(1)


def distance(name: str, u: Column, v: Column, compat: bool = False, metric: Metric = PLANAR) -> Column:
    """The distance of a name in BY_NAME, to which more may be added; for other names -1 where `compat`."""
    if name in BY_NAME:
        return BY_NAME[name](u, v) if metric is PLANAR else BY_NAME[name](u, v, metric)
    if compat:
        return F.lit(-1.0)
    raise ValueError(f"no distance is called {name!r}; there are {', '.join(BY_NAME)}")


def distance_to(db: DataFrame, query: DataFrame, *names: str, compat: bool = False, metric: Metric = PLANAR) -> DataFrame:
    """db with one column for each named distance to the one query row; the query goes to the tasks, db is not shuffled."""
    both = db.crossJoin(F.broadcast(query))
    return both.select(*db.columns, "query_tid", *(distance(n, F.col("pts"), F.col("query_pts"), compat, metric).alias(n) for n in names))


def nearest(db: DataFrame, query: DataFrame, name: str, k: int, metric: Metric = PLANAR) -> DataFrame:
    """The k trajectories nearest to the query, itself left out; ties go to the smaller id."""
    found = distance_to(db, query, name, metric=metric).where("tid <> query_tid").select("query_tid", "tid", F.col(name).alias("distance"))
    return found.orderBy("distance", "tid").limit(k)


#: Distances by vertices of equal place; blocks of these are measured at once.
BY_PLACE = ("sum_of_pairs", "dtw")
#: Trajectories and points of one block of a group, about, and the pairs that are measured together.
BLOCK, POINTS, STRIP = 1024, 1 << 18, 1 << 16


def within_groups(db: DataFrame, name: str, group: str = "grp", metric: Metric = PLANAR) -> DataFrame:
    """(grp, i, j, distance) for every pair i < j of one group: the upper triangle of each group's distance matrix."""
    if name in BY_PLACE and metric is PLANAR:
        return _by_place(db, name, group)
    a = db.select(group, F.col("tid").alias("i"), F.col("pts").alias("u"))
    b = db.select(group, F.col("tid").alias("j"), F.col("pts").alias("v"))
    return a.join(b, group).where("i < j").select(group, "i", "j", distance(name, F.col("u"), F.col("v"), metric=metric).alias("distance"))


def _by_place(db: DataFrame, name: str, group: str) -> DataFrame:
    """The same for the distances BY_PLACE: a group's trajectories are dealt into blocks, and every two blocks (each with itself too)
    meet in a group of their own, so that a large group is work for many tasks."""
    kind = {f.name: f.dataType.simpleString() for f in db.schema}
    rows = db.where(F.col(group).isNotNull() & F.col("tid").isNotNull()).select(
        F.col(group).alias("g"), "tid", F.transform("pts", lambda p: p["x"].cast("double")).alias("xs"), F.transform("pts", lambda p: p["y"].cast("double")).alias("ys")
    )
    size = F.greatest(F.count("*") / BLOCK, F.sum(F.coalesce(F.size("xs"), F.lit(0))) / POINTS)
    blocks = rows.groupBy("g").agg(F.greatest(F.ceil(size), F.lit(1)).cast("int").alias("n"))
    dealt = rows.join(blocks, "g").withColumn("own", F.pmod(F.xxhash64("tid"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    place = ["g", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")]
    met = dealt.select(*place, (F.col("own") > F.col("other")).alias("second"), "tid", "xs", "ys")
    squares = name == "dtw"

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tids, second = table.column("tid").combine_chunks(), table.column("second").to_numpy()
        rank = np.asarray(pc.rank(tids, tiebreaker="min")).astype(np.int64)
        kinds = _lengths(table)
        within = table.column("p")[0].as_py() == table.column("q")[0].as_py()
        sides = [[(n, at[second[at] == k]) for n, at in kinds] for k in ((False, False) if within else (False, True))]
        parts = [part for m, a in sides[0] for n, b in sides[1] for part in _measured(table, rank, a, m, b, n, within, squares)]
        first = [np.concatenate([np.zeros(0, t), *(p[k] for p in parts)]) for k, t in enumerate((int, int, float, bool))]
        i, j, far, none = first
        own = pa.array(np.zeros(len(i), int))
        columns = [table.column("g").combine_chunks().take(own), tids.take(pa.array(i)), tids.take(pa.array(j)), pa.array(far, mask=none)]
        return pa.Table.from_arrays(columns, [group, "i", "j", "distance"])

    # few rows make very many pairs: dealt to a number of tasks that adaptive execution does not lower
    many = 4 * db.sparkSession.sparkContext.defaultParallelism
    return met.repartition(many, "g", "p", "q").groupBy("g", "p", "q").applyInArrow(run, f"`{group}` {kind[group]}, i {kind['tid']}, j {kind['tid']}, distance double")


def _lengths(table: pa.Table) -> list[tuple[int, np.ndarray]]:
    """Each length, -1 for null, with the rows that have it."""
    sizes = table.column("xs").combine_chunks().value_lengths().fill_null(-1).to_numpy()
    return [(int(n), np.flatnonzero(sizes == n)) for n in np.unique(sizes)]


def _coordinates(table: pa.Table, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The first n x and y of rows that are as long at least, by place; and whether one of a row's is null."""
    given = [table.column(c).combine_chunks().take(pa.array(at)) for c in ("xs", "ys")]
    whole = [v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1)[:, :n] for v in given]
    none = [v.flatten().is_null().to_numpy(zero_copy_only=False).reshape(len(at), -1)[:, :n].any(axis=1) for v in given]
    return [np.ascontiguousarray(v.T) for v in whole] + [none[0] | none[1]]


def _measured(table, rank, a, m, b, n, within, squares):
    """(i, j, distance, whether it is null) of the pairs of rows a, m points each, and b, n points each: rows of the smaller id first."""
    if not len(a) or not len(b):
        return
    places = min(m, n)
    if places > 0:
        (ax, ay, anull), (bx, by, bnull) = _coordinates(table, a, places), _coordinates(table, b, places)
    rows = max(1, STRIP // len(b))
    for at in range(0, len(a), rows):
        part = slice(at, at + rows)
        before, after = rank[a[part], None] < rank[b], rank[a[part], None] > rank[b]
        chosen = before if within else before | after
        far, none = np.zeros(before.shape), np.zeros(before.shape, bool)
        if places > 0 and (squares or m == n):
            step, rise = np.empty_like(far), np.empty_like(far)
            for k in range(places):
                np.subtract(ax[k, part, None], bx[k], out=step)
                np.subtract(ay[k, part, None], by[k], out=rise)
                step *= step
                rise *= rise
                step += rise
                np.sqrt(step, out=step)
                if squares:
                    step *= step
                far += step
            none |= anull[part, None] | bnull
            if squares:
                np.sqrt(far, out=far)
        if squares:
            if places < 0 or (m != n and places == 0):
                none[:] = True
            elif m != n:
                none |= before if n < m else after  # the later is cut to the length of the earlier, never the other way
        elif m != n or places < 0:
            far[:] = -1.0
        i, j = np.nonzero(chosen)
        first = before[i, j]
        i += at
        yield np.where(first, a[i], b[j]), np.where(first, b[j], a[i]), far[chosen], none[chosen]


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of an upper triangle."""
    return pairs.union(pairs.select("grp", F.col("j").alias("i"), F.col("i").alias("j"), "distance"))
