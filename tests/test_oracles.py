"""Every registered query against its SQL counterpart, run by DuckDB on the same files."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from wayline.plans import analysis, registry


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, spark, sf_dir, sql):
    made = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(made.columns)
    rows = [tuple(_plain(r[c]) for c in columns) for r in made.collect()]
    asked = sql.execute(registry.ORACLES[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == columns
    wanted = [tuple(_plain(row[names.index(c)]) for c in columns) for row in asked.fetchall()]
    assert sorted(rows, key=repr) == sorted(wanted, key=repr)
    assert rows


def test_near_pairs_equal_all_against_all(spark, sf_dir, sql):
    found = analysis.cluster.near_pairs(analysis.steps(spark, sf_dir), analysis.EPS)
    assert sorted(map(tuple, found.collect())) == sorted(sql.execute(analysis.STEP_PAIRS).fetchall())


def _levenshtein(a, b):
    row = np.arange(len(b) + 1)
    letters = np.array([ord(c) for c in b])
    for i, c in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (letters != ord(c)))
        best = np.concatenate([[i], best]) - np.arange(len(b) + 1)
        row = np.minimum.accumulate(best) + np.arange(len(b) + 1)
    return int(row[-1])


def test_text_distances_equal_a_plain_loop(spark, sf_dir, sql):
    asked = sql.execute("SELECT arg_min(text, item_id) FROM benchmark").fetchone()[0]
    texts = dict(sql.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    got = dict(map(tuple, registry.QUERIES["edit_distance_text"](spark, sf_dir).select("doc_id", "distance").collect()))
    assert set(got) == set(texts)
    for doc in sorted(texts)[:60]:
        assert got[doc] == _levenshtein(texts[doc], asked)
