"""Lengths of geodesics, and distances to geodesic segments with the nearest point, in Arrow batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.geodesic import inverse, to_segment


def _with(rows: DataFrame, given: tuple[str, ...], names: tuple[str, ...], f) -> DataFrame:
    """rows with columns f(arrays of the given columns) added; null where one of those is null or not finite."""
    taken = set(names) & set(rows.columns)
    if taken:
        raise ValueError(f"the table has columns {sorted(taken)} already")

    def run(batches):
        for batch in batches:
            columns = np.array([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in given], float)
            good = np.isfinite(columns).all(axis=0)
            made = f(*columns[:, good])
            for name, values in zip(names, made):
                whole = np.full(len(good), np.nan)
                whole[good] = values
                batch = batch.append_column(name, pa.array(whole, mask=np.isnan(whole)))
            yield batch

    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema)
    return rows.mapInArrow(run, kinds + "".join(f", `{n}` double" for n in names))


def lengths(rows: DataFrame, lat1="lat1", lon1="lon1", lat2="lat2", lon2="lon2", name="metres") -> DataFrame:
    """rows with the geodesic distance between the points of each; null where a coordinate is missing or not finite."""
    return _with(rows, (lat1, lon1, lat2, lon2), (name,), lambda *c: inverse(*c)[:1])


def segment_distances(rows: DataFrame, u=("ulat", "ulon"), v=("vlat", "vlon"), p=("plat", "plon")) -> DataFrame:
    """rows with metres, nearest_lat and nearest_lon: the distance of p to the geodesic segment u-v, and its nearest point there."""
    return _with(rows, (*u, *v, *p), ("metres", "nearest_lat", "nearest_lon"), to_segment)
