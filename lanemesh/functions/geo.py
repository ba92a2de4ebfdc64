"""Geometry as column expressions. Points are (lat, lon) columns or structs of lon and lat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371000.0
METRES_A_DEGREE = 111320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the sphere, by the two-argument arc tangent."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def planar2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared distance in raw degrees."""
    return (lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2)


def metres_to_degrees(metres: Column) -> Column:
    return metres / METRES_A_DEGREE


def clamp01(t: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def projection(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """t, x and y of the point of segment a-b next to p, in raw degrees; a itself if the segment is a point."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size == 0, F.lit(0.0)).otherwise(clamp01(((px - ax) * dx + (py - ay) * dy) / size))
    return t, ax + t * dx, ay + t * dy


def segment_distance(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres from a point to its projection on a segment."""
    _, x, y = projection(lon, lat, lon1, lat1, lon2, lat2)
    return haversine(lat, lon, y, x)


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def line_length(geometry: str) -> Column:
    """Metres along an array of points."""
    a = F.slice(geometry, 1, F.greatest(F.size(geometry) - 1, F.lit(0)))
    b = F.slice(geometry, 2, F.greatest(F.size(geometry) - 1, F.lit(0)))
    steps = F.zip_with(a, b, lambda p, q: haversine(p["lat"], p["lon"], q["lat"], q["lon"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def segments(line: Column) -> Column:
    """An array of points as an array of structs a, b; a single point gives one segment of no length."""
    n = F.size(line)
    heads = F.when(n == 1, line).otherwise(F.slice(line, 1, F.greatest(n - 1, F.lit(0))))
    tails = F.when(n == 1, line).otherwise(F.slice(line, 2, F.greatest(n - 1, F.lit(0))))
    return F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def consecutive(nodes: str) -> Column:
    """An array as an array of structs src, dst of each element and the next."""
    n = F.greatest(F.size(nodes) - 1, F.lit(0))
    return F.arrays_zip(F.slice(nodes, 1, n).alias("src"), F.slice(nodes, 2, n).alias("dst"))


def _turn(a: Column, b: Column, c: Column) -> Column:
    """Sign of the turn a-b-c: 1 left, -1 right, 0 collinear."""
    return F.signum((b["lon"] - a["lon"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lon"] - a["lon"]))


def _within(a: Column, b: Column, p: Column) -> Column:
    """p, known to be collinear with a-b, lies between them."""
    return p["lon"].between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & p["lat"].between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))


def on_segment(a: Column, b: Column, p: Column) -> Column:
    return (_turn(a, b, p) == 0) & _within(a, b, p)


def crosses(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Segments a-b and c-d have a point in common, touching and overlap included."""
    t1, t2, t3, t4 = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    proper = (t1 * t2 < 0) & (t3 * t4 < 0)
    touch = ((t1 == 0) & _within(a, b, c)) | ((t2 == 0) & _within(a, b, d)) | ((t3 == 0) & _within(c, d, a)) | ((t4 == 0) & _within(c, d, b))
    return proper | touch


def in_rings(p: Column, rings: Column) -> Column:
    """p is inside the rings by the even-odd rule (so later rings are holes), or on their border."""

    def crossings(ring: Column) -> Column:
        ray = F.filter(segments(ring), lambda s: ((s["a"]["lat"] > p["lat"]) != (s["b"]["lat"] > p["lat"])) & (p["lon"] < (s["b"]["lon"] - s["a"]["lon"]) * (p["lat"] - s["a"]["lat"]) / (s["b"]["lat"] - s["a"]["lat"]) + s["a"]["lon"]))
        return F.size(ray)

    border = F.exists(rings, lambda r: F.exists(segments(r), lambda s: on_segment(s["a"], s["b"], p)))
    return border | (F.aggregate(rings, F.lit(0), lambda n, r: n + crossings(r)) % 2 == 1)


def line_meets_line(line: Column, other: Column) -> Column:
    return F.exists(segments(line), lambda s: F.exists(segments(other), lambda t: crosses(s["a"], s["b"], t["a"], t["b"])))


def line_meets_parts(line: Column, parts: Column) -> Column:
    """A polyline has a point in common with one of the polygons (each a list of rings)."""
    # most lines that meet a polygon cross its border, which is found sooner than points inside
    return F.exists(parts, lambda rings: F.exists(rings, lambda r: line_meets_line(line, r)) | F.exists(line, lambda p: in_rings(p, rings)))


def line_meets_circle(line: Column, centre: Column, radius: Column) -> Column:
    """A polyline comes within `radius` raw degrees of the centre."""

    def near(s: Column) -> Column:
        _, x, y = projection(centre["lon"], centre["lat"], s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"])
        return planar2(y, x, centre["lat"], centre["lon"]) <= radius * radius

    return F.exists(segments(line), near)


def lines_within(line: Column, other: Column, distance: float) -> Column:
    """Two polylines come within `distance` raw degrees of each other."""

    def close(s: Column, t: Column) -> Column:
        def near(p, q):
            _, x, y = projection(p["lon"], p["lat"], q["a"]["lon"], q["a"]["lat"], q["b"]["lon"], q["b"]["lat"])
            return planar2(y, x, p["lat"], p["lon"]) <= distance * distance

        return crosses(s["a"], s["b"], t["a"], t["b"]) | near(s["a"], t) | near(s["b"], t) | near(t["a"], s) | near(t["b"], s)

    return F.exists(segments(line), lambda s: F.exists(segments(other), lambda t: close(s, t)))


def box(line: Column) -> dict[str, Column]:
    """Least and greatest lon and lat of an array of points."""
    lon, lat = F.transform(line, lambda p: p["lon"]), F.transform(line, lambda p: p["lat"])
    return {"minx": F.array_min(lon), "maxx": F.array_max(lon), "miny": F.array_min(lat), "maxy": F.array_max(lat)}
