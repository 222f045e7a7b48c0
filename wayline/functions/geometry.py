"""Point and segment metrics on planar columns. A point is a pair of double columns, or a struct (x, y)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, though body names it often."""
    return F.get(F.transform(F.array(value), body), 0)


def squared(ax, ay, bx, by) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def euclidean(ax, ay, bx, by) -> Column:
    return F.sqrt(squared(ax, ay, bx, by))


def between(a: Column, b: Column) -> Column:
    """Distance of two points given as structs."""
    return euclidean(a["x"], a["y"], b["x"], b["y"])


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays; NaN where their lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(total)).otherwise(F.lit(float("nan")))


def along(ux, uy, vx, vy, px, py) -> Column:
    """Where p falls on the line through u and v: 0 at u, 1 at v; null where u equals v."""
    length = squared(ux, uy, vx, vy)
    return F.when(length > 0, ((px - ux) * (vx - ux) + (py - uy) * (vy - uy)) / length)


def segment_distance(ux, uy, vx, vy, px, py, degenerate: float = 1e-12) -> Column:
    """Distance of p to the segment u-v, to u where the segment is shorter than the root of `degenerate`."""
    t = F.least(F.greatest(along(ux, uy, vx, vy, px, py), F.lit(0.0)), F.lit(1.0))
    onto = euclidean(px, py, ux + t * (vx - ux), uy + t * (vy - uy))
    return F.when(squared(ux, uy, vx, vy) < degenerate, euclidean(px, py, ux, uy)).otherwise(onto)


def line_projection(ux, uy, vx, vy, px, py) -> tuple[Column, Column]:
    """Foot of p on the line through u and v, not clamped; u where the two are equal."""
    t = F.coalesce(along(ux, uy, vx, vy, px, py), F.lit(0.0))
    return ux + t * (vx - ux), uy + t * (vy - uy)


def side(ax, ay, bx, by) -> Column:
    """-1 where b turns right of a, else 1."""
    return F.when(ax * by - ay * bx < 0, -1.0).otherwise(1.0)


def turning_angle(px, py, x, y, nx, ny) -> Column:
    """Signed turn in degrees at (x, y) between the steps from (px, py) and to (nx, ny); 0 at ends and where a step has no length."""
    ax, ay, bx, by = x - px, y - py, nx - x, ny - y
    la, lb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    cosine = F.greatest(F.least((ax * bx + ay * by) / (la * lb), F.lit(1.0)), F.lit(-1.0))
    return F.when((la > 0) & (lb > 0), F.degrees(F.acos(cosine) * side(ax, ay, bx, by))).otherwise(0.0)


def haversine(lat1, lon1, lat2, lon2, radius=6371008.8) -> Column:
    """Great-circle distance in metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def rhumb_bearing(lat1, lon1, lat2, lon2) -> Column:
    """Bearing in degrees along a line of constant heading, the short way round the antimeridian."""
    d = F.radians(lon2 - lon1)
    d = F.when(d > 3.141592653589793, d - 2 * 3.141592653589793).when(d < -3.141592653589793, d + 2 * 3.141592653589793).otherwise(d)
    up = lambda lat: F.log(F.tan(F.radians(F.greatest(F.least(lat, F.lit(89.999999)), F.lit(-89.999999))) / 2 + 0.7853981633974483))
    stretch = up(lat2) - up(lat1)
    return F.pmod(F.degrees(F.atan2(d, stretch)) + 360, F.lit(360.0))


#: The WGS84 ellipsoid.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def geodesic(lat1, lon1, lat2, lon2, rounds: int = 12) -> Column:
    """Distance in metres on the WGS84 ellipsoid by Vincenty's inverse formula; null for nearly antipodal points, where it fails."""
    a, f = WGS84_A, WGS84_F
    b = a * (1 - f)
    u1, u2 = F.atan((1 - f) * F.tan(F.radians(lat1))), F.atan((1 - f) * F.tan(F.radians(lat2)))
    given = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), F.radians(lon2 - lon1).alias("l"))

    def angles(g, lam):
        s, c = F.sin(lam), F.cos(lam)
        sin_s = F.sqrt(F.pow(g["c2"] * s, 2) + F.pow(g["c1"] * g["s2"] - g["s1"] * g["c2"] * c, 2))
        return F.struct(sin_s.alias("sin"), (g["s1"] * g["s2"] + g["c1"] * g["c2"] * c).alias("cos"), (g["c1"] * g["c2"] * s).alias("turn"), g["s1"].alias("s1"), g["s2"].alias("s2"))

    def azimuth(t):
        sin_a = F.when(t["sin"] > 0, t["turn"] / t["sin"]).otherwise(0.0)
        return F.struct(t["sin"].alias("sin"), t["cos"].alias("cos"), F.atan2(t["sin"], t["cos"]).alias("sigma"), sin_a.alias("sin_a"), (1 - sin_a * sin_a).alias("cos2_a"), (2 * t["s1"] * t["s2"]).alias("both"))

    def middle(t):
        cos_m = F.when(t["cos2_a"] > 0, t["cos"] - t["both"] / t["cos2_a"]).otherwise(0.0)
        c = f / 16 * t["cos2_a"] * (4 + f * (4 - 3 * t["cos2_a"]))
        u = t["cos2_a"] * (a * a - b * b) / (b * b)
        return F.struct(*(t[n].alias(n) for n in ("sin", "cos", "sigma", "sin_a")), cos_m.alias("cos_m"), c.alias("c"), u.alias("u"))

    def terms(g, lam, body):
        return let(angles(g, lam), lambda t: let(azimuth(t), lambda t2: let(middle(t2), body)))

    def improve(state, _):
        g, lam = state["g"], state["lam"]

        def changed(t):
            new = g["l"] + (1 - t["c"]) * f * t["sin_a"] * (t["sigma"] + t["c"] * t["sin"] * (t["cos_m"] + t["c"] * t["cos"] * (2 * t["cos_m"] * t["cos_m"] - 1)))
            return let(new, lambda n: F.struct(g.alias("g"), n.alias("lam"), F.abs(n - lam).alias("change")))

        return terms(g, lam, changed)

    def finish(state):
        def length(t):
            u, sin_s, cos_s, cos_m = t["u"], t["sin"], t["cos"], t["cos_m"]
            big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            extra = small * sin_s * (cos_m + small / 4 * (cos_s * (2 * cos_m * cos_m - 1) - small / 6 * cos_m * (4 * sin_s * sin_s - 3) * (4 * cos_m * cos_m - 3)))
            return b * big * (t["sigma"] - extra)

        return F.when(state["change"] < 1e-9, terms(state["g"], state["lam"], length))

    start = F.struct(given.alias("g"), F.radians(lon2 - lon1).alias("lam"), F.lit(0.0).cast("double").alias("change"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, improve, finish)
