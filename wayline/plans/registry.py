"""The registered queries and their SQL counterparts; importing the modules below fills them."""

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(column):
    """Six decimals, and no negative zero: what two engines agree on."""
    return F.round(column, 6) + F.lit(0.0)


from . import analysis, cells, distances, files, points, shapes, strings  # noqa: E402, F401
