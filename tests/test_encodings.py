"""Encodings of trajectories whose headings lie on the edge between two letters, against the registered SQL."""

import datetime

import duckdb
import pytest

from wayline.plans import registry


def both(spark, folder, name, users):
    """Rows of a query and of its SQL over trajectories given by their values."""
    begin = datetime.datetime(2024, 1, 1)
    rows = [(1000 * u + i, begin + datetime.timedelta(hours=i), u, float(v)) for u, values in users.items() for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    made = registry.QUERIES[name](spark, str(folder))
    return sorted(map(tuple, made.collect())), sorted(con.execute(registry.ORACLES[name]).fetchall())


#: Two falls of 11.33, equal to all but the last bit.
EQUAL_STEPS = [119.57, 25.69, 14.36, 3.03, 16.72, 0.6]


def test_turn_between_equal_steps(spark, tmp_path):
    made, wanted = both(spark, tmp_path, "encode_local", {1: EQUAL_STEPS})
    assert made == wanted


#: The 13th value lies 12 below the first, 12 steps later.
DIAGONAL = [21.44, 68.89, 54.86, 156.47, 17.57, 63.45, 34.72, 59.17, 69.42, 4.48, 58.53, 6.52, 33.44, 15.0, 76.56]


def test_diagonal_to_the_first_point(spark, tmp_path):
    made, wanted = both(spark, tmp_path, "encode_global_fsp", {1: DIAGONAL})
    assert made == wanted


def test_zipped_letters_of_equal_steps_and_diagonals(spark, tmp_path):
    made, wanted = both(spark, tmp_path, "zip_features", {1: EQUAL_STEPS, 2: DIAGONAL, 3: [1.0, 2.0, 1.0, 1.0, 0.0], 4: [5.0]})
    assert made == wanted


def test_tokens_of_a_diagonal(spark, tmp_path):
    """The first trajectory is the second but for one value, which keeps the letters of the SQL."""
    near = [33.43 if v == 33.44 else v for v in DIAGONAL]
    made, wanted = both(spark, tmp_path, "edit_distance_tokens", {1: near, 2: DIAGONAL})
    assert made == wanted == [(1, 0), (2, 0)]


@pytest.mark.parametrize("name", ["encode_global", "encode_global_fsp", "encode_local", "encode_length", "edit_distance_tokens"])
def test_short_trajectories(spark, tmp_path, name):
    made, wanted = both(spark, tmp_path, name, {1: [5.0], 2: [1.0, 4.0], 3: [1.0, 2.0, 3.0], 4: [1.0, 1.0, 7.5]})
    assert made == wanted and wanted
