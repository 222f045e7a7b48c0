"""Geohash of WGS84 coordinates by whole-number arithmetic on columns; up to twelve characters."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the alphabet of geohash.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
#: Neighbours in the order in which they are listed: steps east and north.
STEPS = ((-1, 0), (1, 0), (0, -1), (-1, -1), (1, -1), (0, 1), (-1, 1), (1, 1))


def _bits(length: int) -> tuple[int, int]:
    if not 1 <= length <= 12:
        raise ValueError("a geohash has 1 to 12 characters here")
    return (5 * length + 1) // 2, 5 * length // 2


def _cells(lat: Column, lon: Column, length: int) -> tuple[Column, Column]:
    """Column and row of the cell, counted from the south-west."""
    wide, high = _bits(length)
    x = F.floor(lon / 180 * float(1 << (wide - 1))) + (1 << (wide - 1))
    y = F.floor(lat / 90 * float(1 << (high - 1))) + (1 << (high - 1))
    return x, y


def _spell(x: Column, y: Column, length: int) -> Column:
    wide, high = _bits(length)
    letters = []
    for c in range(length):
        code = F.lit(0).cast("long")
        for b in range(5):
            k = 5 * c + b
            axis, left = (x, wide - 1 - k // 2) if k % 2 == 0 else (y, high - 1 - k // 2)
            code = code + F.shiftleft(F.shiftright(axis.cast("long"), left).bitwiseAND(F.lit(1)), 4 - b)
        letters.append(F.substr(F.lit(ALPHABET), code.cast("int") + 1, F.lit(1)))
    return F.concat(*letters)


def encode(lat: Column, lon: Column, length: int = 8, compat: bool = False) -> Column:
    """The cell of a point; null outside lat [-90, 90), lon [-180, 180) or for a missing coordinate.

    compat: an empty text for a missing coordinate, and a text that says so for one out of range.
    """
    given = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    inside = (lat >= -90) & (lat < 90) & (lon >= -180) & (lon < 180)
    cell = F.when(given & inside, _spell(*_cells(lat, lon, length), length))
    if not compat:
        return cell
    wrong = F.concat(F.lit("Unable to geohash:"), lat.cast("string"), F.lit(" "), lon.cast("string"))
    return F.when(~given, "").otherwise(F.coalesce(cell, wrong))


def _codes(cell: Column) -> Column:
    return F.transform(F.split(F.lower(cell), ""), lambda c: F.when(c == "", -1).otherwise(F.instr(F.lit(ALPHABET), c) - 1))


def _axes(cell: Column) -> Column:
    """(x, y, bits): the cell's column and row, and how many bits were read."""
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).alias("k"))

    def read(s, code):
        x, y, k = s["x"], s["y"], s["k"]
        for b in range(5):
            bit = F.shiftright(code, 4 - b).bitwiseAND(F.lit(1)).cast("long")
            even = (k + b) % 2 == 0
            x, y = F.when(even, x * 2 + bit).otherwise(x), F.when(even, y).otherwise(y * 2 + bit)
        return F.struct(x.alias("x"), y.alias("y"), (k + 5).alias("k"))

    return F.aggregate(F.filter(_codes(cell), lambda c: c >= 0), start, read)


def decode(cell: Column, compat: bool = False) -> Column:
    """(lat, lon) of the south-west corner, in any case of letters; null for text that is no geohash (compat: 0, 0)."""
    a = _axes(cell)
    wide, high = F.floor((a["k"] + 1) / 2), F.floor(a["k"] / 2)
    lon = a["x"].cast("double") / F.pow(F.lit(2.0), wide.cast("double")) * 360 - 180
    lat = a["y"].cast("double") / F.pow(F.lit(2.0), high.cast("double")) * 180 - 90
    fine = F.length(F.translate(F.lower(cell), ALPHABET, "")) == 0
    other = F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")) if compat else F.lit(None)
    return F.when(fine, F.struct(lat.alias("lat"), lon.alias("lon"))).otherwise(other)


def neighbours(lat: Column, lon: Column, length: int) -> Column:
    """The cells around a point's cell: west, east, south, south-west, south-east, north, north-west, north-east; over the poles there are none."""
    wide, high = _bits(length)
    x, y = _cells(lat, lon, length)
    around = []
    for dx, dy in STEPS:
        row = y + dy
        around.append(F.when((row >= 0) & (row < (1 << high)), _spell(F.pmod(x + dx, F.lit(1 << wide)), row, length)))
    return F.filter(F.array(*around), lambda c: c.isNotNull())


def encode_pair(first: Column, second: Column, length: int = 8, order: str = "lonlat", compat: bool = False) -> Column:
    """encode() of two coordinates in a stated order: `lonlat` or `latlon`."""
    if order not in ("lonlat", "latlon"):
        raise ValueError("the order is lonlat or latlon")
    lat, lon = (first, second) if order == "latlon" else (second, first)
    return encode(lat, lon, length, compat)
