"""Spatial joins: nodes within reach and nearest edges; zones over edges and nodes; overlays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanemesh.functions import geo
from lanemesh.lineage import cut
from lanemesh.operators.boxes import SIDES, dealt, meeting
from lanemesh.operators.graph import degrees
from lanemesh.operators.nearest import nearest_nodes
from lanemesh.operators.paths import both_orders, edges_of_paths
from lanemesh.schemas import Graph

#: Twice the area, in square degrees, that rounding may give to three points in a line.
SLACK = 1e-12
BARRIER = 1e-6
LEAST_DEGREE = 3
BLOCKING_PENALTY = 100.0
DEFAULT_PENALTY = 15.0
#: Side of the smallest cells for nearest edges, in cutoffs; sizes of cells, each twice the one before.
CELLS_A_CUTOFF, LEVELS = 4, 7
#: Points and edges of a cell that meet in one task, at most; edges that are too few to be dealt out; pairs of them in arrays at a time.
POINTS, EDGES, LEAST_EDGES, PAIRS = 262_144, 524_288, 8192, 1_000_000
#: Pairs of points and edges that are compared without a look at what their box rules out.
FEW = 16384
METRES_A_RADIAN_DEGREE = math.radians(1) * geo.EARTH_RADIUS


def snap(points: DataFrame, nodes: DataFrame, metres: float = 100.0, key: str = "point_id") -> DataFrame:
    """key, node_id, distance of the nearest node by haversine that is less than so many metres away."""
    return nearest_nodes(points, nodes, key, "haversine", metres).where(F.col("distance") < metres)


def _crossed(rows: DataFrame, dlon: float, dlat: float, side_x: float, side_y: float) -> DataFrame:
    """rows (src_lon, src_lat, dst_lon, dst_lat) with each cell cx, cy that the segment, widened by dlon and dlat, can reach: per column of cells, those along the part of the segment that is near it."""
    ax, ay, bx, by = (F.col(c) for c in ("src_lon", "src_lat", "dst_lon", "dst_lat"))
    rows = rows.withColumn("cx", F.explode(F.sequence(geo.cell(F.least(ax, bx) - dlon, side_x), geo.cell(F.greatest(ax, bx) + dlon, side_x))))
    share = lambda x: F.when(bx == ax, F.lit(0.0)).otherwise(geo.clamp01((x - ax) / (bx - ax)))
    rows = rows.withColumns({"y1": ay + share(F.col("cx") * side_x - dlon) * (by - ay), "y2": F.when(bx == ax, by).otherwise(ay + share((F.col("cx") + 1) * side_x + dlon) * (by - ay))})
    cells = F.sequence(geo.cell(F.least("y1", "y2") - dlat, side_y), geo.cell(F.greatest("y1", "y2") + dlat, side_y))
    return rows.withColumn("cy", F.explode(cells)).drop("y1", "y2")


def _projected(px, py, ax, ay, bx, by) -> tuple[np.ndarray, np.ndarray]:
    """The place on each edge nearest to points, in raw degrees."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    still = size == 0
    t = np.clip(((px - ax) * dx + (py - ay) * dy) / np.where(still, 1.0, size), 0.0, 1.0)
    t = np.where(still, 0.0, t)
    return ax + t * dx, ay + t * dy


def _blocks(lon: np.ndarray, lat: np.ndarray, ends: tuple[np.ndarray, ...], dlat: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of points and of all edges that may be nearest to one of them, within dlat degrees of latitude.

    Points are halved until they make few pairs with the edges left. With r the reach of their box from its middle, a point
    has an edge no farther than r more than the middle has, and an edge is no nearer to it than r less, times the cosine
    of the latitude, by which degrees may overestimate a distance; what exceeds that goes."""
    stack = [(np.arange(len(lon)), np.arange(len(ends[0])))]
    shrunk = math.cos(math.radians(min(90.0, float(np.abs(lat).max(initial=0.0)) + 2 * dlat))) * (1 - 1e-6)
    while stack:
        own, seen = stack.pop()
        if not len(own) or not len(seen):
            continue
        if len(own) * len(seen) <= FEW:
            yield own, seen
            continue
        west, east, south, north = lon[own].min(), lon[own].max(), lat[own].min(), lat[own].max()
        mx, my = (west + east) / 2, (south + north) / 2
        r = math.hypot(east - west, north - south) / 2
        x, y = _projected(mx, my, *(e[seen] for e in ends))
        far = np.hypot(x - mx, y - my)
        seen = seen[shrunk * (far - r) <= min((far.min() + r) * (1 + 1e-6) + 1e-10, dlat)]
        if r == 0:
            yield own, seen
            continue
        by = np.argsort(lon[own] if east - west > north - south else lat[own], kind="stable")
        half = len(by) // 2
        stack += [(own[by[:half]], seen), (own[by[half:]], seen)]


def _nearest_rows(points: pa.Table, edges: pa.Table, dlat: float, dlon: float) -> pa.Table:
    """key_, ord and distance (far) of the edges that may be nearest to each point: within rounding of the least distance, and within the cutoff in both coordinates."""
    get = lambda table, name: table[name].to_numpy()
    lat, lon = get(points, "plat"), get(points, "plon")
    ends, order = tuple(get(edges, c) for c in ("src_lon", "src_lat", "dst_lon", "dst_lat")), get(edges, "ord")
    who, what, metres = [], [], []
    # by how much a distance in degrees, shrunk by the point's latitude, may differ from that on the sphere within the cutoff, as a share; near poles it says nothing
    steep = math.radians(min(89.999, float(np.abs(lat).max(initial=0.0)) + dlat))
    off = math.radians(dlat) * math.tan(steep) + math.radians(dlon) ** 2 + 1e-9
    slack = 1 + 3 * off + 1e-6 if off < 0.1 else None
    narrow = np.cos(np.radians(lat))
    for own, seen in _blocks(lon, lat, ends, dlat):
        step = max(1, PAIRS // len(seen)) if len(seen) else len(own)
        for k in range(0, len(own), step):
            at = own[k : k + step]
            px, py = lon[at, None], lat[at, None]
            x, y = _projected(px, py, *(e[seen] for e in ends))
            dy, dx = np.abs(py - y), np.abs(px - x)
            flat = np.where((dy <= dlat) & (dx <= dlon), np.hypot(dy, dx * narrow[at, None]), np.inf)
            i, j = np.nonzero((flat < np.inf) & (slack is None or flat <= flat.min(axis=1, initial=np.inf)[:, None] * slack + 1e-9))
            if not len(i):
                continue
            y1, y2, x1, x2 = (np.radians(v) for v in (lat[at[i]], y[i, j], lon[at[i]], x[i, j]))
            a = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
            far = 2 * geo.EARTH_RADIUS * np.arctan2(np.sqrt(a), np.sqrt(1 - a))
            least = np.full(len(at), np.inf)
            np.minimum.at(least, i, far)
            near = far <= least[i] * (1 + 1e-7) + 1e-6
            who.append(at[i[near]])
            what.append(seen[j[near]])
            metres.append(far[near])
    who, what, metres = (np.concatenate(v) if v else np.zeros(0, kind) for v, kind in ((who, np.int64), (what, np.int64), (metres, np.float64)))
    return pa.table({"key_": points["key_"].take(pa.array(who)), "ord": pa.array(order[what]), "far": pa.array(metres)})


def _leaves(here: DataFrame) -> DataFrame:
    """cx, cy of the smallest cells of points, and at: how often their side is doubled, as long as the cell has no more than POINTS points, so that few cells hold all points and a long edge crosses few."""
    cells = here.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    at = F.lit(0)
    for k in range(1, LEVELS):
        inside = F.sum("n").over(W.partitionBy(F.shiftright("cx", k), F.shiftright("cy", k)))
        at = at + (inside <= POINTS).cast("int")
    return cells.select("cx", "cy", at.alias("at"))


def _laid_out(here: DataFrame, segments: DataFrame, dlat: float, dlon: float) -> tuple[DataFrame, DataFrame]:
    """Points (plat, plon and more) and segments by at, cx, cy: the cells of points as _leaves() has them, and the segments that can be within the cutoff of each."""
    side_x, side_y = CELLS_A_CUTOFF * dlon, CELLS_A_CUTOFF * dlat
    here = here.withColumns({"cx": geo.cell(F.col("plon"), side_x), "cy": geo.cell(F.col("plat"), side_y)})
    leaves = cut(_leaves(here))
    up = {c: F.call_function("shiftright", F.col(c), F.col("at")) for c in ("cx", "cy")}
    points = here.join(leaves, ["cx", "cy"]).withColumns(up)
    cells = cut(leaves.withColumns(up).distinct())
    right = None
    # there are LEVELS sizes at most
    for k in sorted(r[0] for r in cells.select("at").distinct().collect()) or [0]:
        crossed = _crossed(segments, dlon, dlat, side_x * 2**k, side_y * 2**k).withColumn("at", F.lit(k))
        own = crossed.join(cells.where(F.col("at") == k), ["at", "cx", "cy"], "left_semi")
        right = own if right is None else right.unionByName(own)
    return points, right


def nearest_edges(points: DataFrame, graph: Graph, metres: float = 50.0, key: str = "point_id") -> DataFrame:
    """key, src, dst, distance, t, lat, lon of the projection on the nearest edge, taken straight between its nodes, up to so many metres away; ties to the least ord.

    The projection is made in raw degrees. Edges between the same two nodes are laid out once, over cells as large as their points allow, and a task
    compares the points of a cell with its edges, POINTS by EDGES at most, in arrays, without edges that boxes of points rule out; what may be the nearest
    edge of a point leaves it, and the least distance of those and of all edges between their nodes decides. Cells with more rows are dealt out."""
    top = max(abs(x or 0.0) for x in graph.nodes.agg(F.min("lat"), F.max("lat")).first())
    dlat = metres / METRES_A_RADIAN_DEGREE * 1.001
    dlon = dlat / max(math.cos(math.radians(min(89.0, top + dlat))), 1e-3)
    at = lambda s: graph.nodes.select(F.col("id").alias(s), F.col("lat").alias(f"{s}_lat"), F.col("lon").alias(f"{s}_lon"))
    ends = {"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}
    rows = cut(graph.edges.select("src", "dst", "ord").join(at("src"), "src").join(at("dst"), "dst").withColumns(ends))
    # from the lesser node to the other, whatever the direction
    turned = {f"{s}_{c}": F.when(F.col("src") == F.col(e), F.col(f"src_{c}")).otherwise(F.col(f"dst_{c}")) for s, e in (("src", "a"), ("dst", "b")) for c in ("lon", "lat")}
    segments = cut(rows.select("a", "b", "ord", *(v.alias(k) for k, v in turned.items())).groupBy("a", "b").agg(F.min("ord").alias("ord"), *(F.min(k).alias(k) for k in turned)))
    here = cut(points.select(key, F.col("lat").alias("plat"), F.col("lon").alias("plon")))
    t, x, y = geo.projection(F.col("plon"), F.col("plat"), F.col("src_lon"), F.col("src_lat"), F.col("dst_lon"), F.col("dst_lat"))
    distance = geo.haversine(F.col("plat"), F.col("plon"), y, x)
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a small table of edges makes many rows: every core takes some
    left, right = _laid_out(here, segments.drop("a", "b").repartition(tasks, "ord"), dlat, dlon)
    left, right, keys = dealt(left, right, ["at", "cx", "cy"], POINTS, min(EDGES, max(LEAST_EDGES, 2 * segments.count() // tasks)))
    kind = points.schema[key].dataType.simpleString()

    def near(p: pa.Table, e: pa.Table) -> pa.Table:
        return _nearest_rows(p.rename_columns([c if c != key else "key_" for c in p.column_names]), e, dlat, dlon).rename_columns([key, "ord", "far"])

    met = cut(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(near, f"{key} {kind}, ord long, far double"))
    # of what several tasks have found for a point, little can be the nearest
    met = met.join(met.groupBy(key).agg(F.min("far").alias("least")), key).where(F.col("far") <= F.col("least") * (1 + 2e-7) + 2e-6).select(key, "ord")
    met = cut(met.join(segments.select("ord", "a", "b"), "ord").drop("ord"))
    met = met.join(rows, ["a", "b"]).join(here, key)
    first = met.groupBy(key).agg(F.min(F.struct(distance.alias("distance"), "ord", "src", "dst")).alias("e")).where(F.col("e.distance") <= metres)
    found = cut(first.select(key, "e.ord", "e.src", "e.dst")).join(here, key).join(at("src"), "src").join(at("dst"), "dst")
    found = found.select(key, "src", "dst", distance.alias("distance"), t.alias("t"), y.alias("lat"), x.alias("lon"), *(f"{s}_{c}" for s in ("src", "dst") for c in ("lat", "lon")))
    legs = [geo.haversine(F.col("lat"), F.col("lon"), F.col(f"{s}_lat"), F.col(f"{s}_lon")).alias(f"{s}_dist") for s in ("src", "dst")]
    return found.select(key, "src", "dst", "distance", "t", "lat", "lon", *legs)


def virtual_nodes(points: DataFrame, graph: Graph, metres: float = 50.0, key: str = "point_id") -> DataFrame:
    """key, lat, lon, neighbours (array of id, dist), source of the points projected on their nearest edge."""
    found = nearest_edges(points, graph, metres, key)
    legs = F.array(F.struct(F.col("src").alias("id"), F.col("src_dist").alias("dist")), F.struct(F.col("dst").alias("id"), F.col("dst_dist").alias("dist")))
    return found.select(key, "lat", "lon", legs.alias("neighbours"), F.when(F.col("distance") > 0, "interpolated").otherwise("coordinate").alias("source"))


def parse_zones(features: DataFrame) -> DataFrame:
    """Zones from GeoJSON text: columns zone_id, ord, feature, and optionally forced_type. Features that can't be read are left out; circles need a radius above 0."""
    doc = F.try_parse_json("feature")
    get = lambda path, kind: F.try_variant_get(F.col("v"), path, kind)
    out = features.withColumn("v", doc).where(F.col("v").isNotNull())
    inner = get("$.geometry.type", "string")
    pick = lambda path, kind: F.when(inner.isNotNull(), get(f"$.geometry.{path}", kind)).otherwise(get(f"$.{path}", kind))
    pt = lambda c: F.struct(F.element_at(c, 1).alias("lon"), F.element_at(c, 2).alias("lat"))
    line = lambda cs: F.transform(cs, pt)
    kind = pick("type", "string")
    parts = (
        F.when(kind == "Polygon", F.array(F.transform(pick("coordinates", "array<array<array<double>>>"), line)))
        .when(kind == "MultiPolygon", F.transform(pick("coordinates", "array<array<array<array<double>>>>"), lambda p: F.transform(p, line)))
        .when(kind == "LineString", F.array(F.array(line(pick("coordinates", "array<array<double>>")))))
        .when(kind == "Point", F.array(F.array(F.array(pt(pick("coordinates", "array<double>"))))))
    )
    forced = F.col("forced_type") if "forced_type" in features.columns else F.lit(None).cast("string")
    block = F.coalesce(forced, get("$.properties.blockType", "string"), F.lit("block"))
    # an explicit null penalty of a flood zone blocks; an absent one counts DEFAULT_PENALTY
    named = F.array_contains(F.json_object_keys(F.get_json_object("feature", "$.properties")), "penalty")
    penalty = F.when(F.coalesce(named, F.lit(False)), get("$.properties.penalty", "double")).when(block == "flood", F.lit(DEFAULT_PENALTY))
    out = out.select("zone_id", "ord", kind.alias("geom_type"), parts.alias("parts"), get("$.properties.radius", "double").alias("radius"), block.alias("block_type"), penalty.alias("penalty"), get("$.properties.path", "array<bigint>").alias("path"))
    return out.where(F.col("parts").isNotNull() | F.col("path").isNotNull())


def prepared(zones: DataFrame) -> DataFrame:
    """zones with centre and reach (degrees, circles only) and box; those without usable geometry go."""
    centre = F.get(F.get(F.get("parts", F.lit(0)), F.lit(0)), F.lit(0))
    circle = (F.col("geom_type") == "Point") & (F.col("radius") > 0)
    reach = F.when(circle, geo.metres_to_degrees(F.col("radius"))).otherwise(F.lit(0.0))
    out = zones.where(F.col("parts").isNotNull() & ((F.col("geom_type") != "Point") | F.col("radius").isNull() | (F.col("radius") > 0)))
    out = out.withColumns({"centre": centre, "reach": reach, **geo.box(F.flatten(F.flatten("parts")))})
    return out.withColumns({"minx": F.col("minx") - F.col("reach"), "maxx": F.col("maxx") + F.col("reach"), "miny": F.col("miny") - F.col("reach"), "maxy": F.col("maxy") + F.col("reach")})


def _apart() -> Column:
    """The straight line through the ends of an edge that laid() has, (ax, ay) and (bx, by), has a zone's box (zminx and so on) wholly on one side."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    turns = [dx * (F.col(y) - F.col("ay")) - dy * (F.col(x) - F.col("ax")) for x in ("zminx", "zmaxx") for y in ("zminy", "zmaxy")]
    return (F.least(*turns) > SLACK) | (F.greatest(*turns) < -SLACK)


def laid(edges: DataFrame) -> DataFrame:
    """src, dst, ord, geometry of edges as a written table, with their boxes and, of those of two points, the ends ax, ay, bx, by (else null): in plain columns, as expressions over arrays would be computed anew for each zone."""
    ends = {f"{e}{c}": F.when(F.size("geometry") == 2, F.get("geometry", F.lit(i))[k]) for i, e in enumerate("ab") for c, k in (("x", "lon"), ("y", "lat"))}
    return cut(edges.select("src", "dst", "ord", "geometry").withColumns({**geo.box(F.col("geometry")), **ends}))


def edges_in_zones(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """zone_id, src, dst, ord of edges whose polyline meets a zone."""
    return _hits(laid(edges), zones)


def _hits(rows: DataFrame, zones: DataFrame) -> DataFrame:
    # the borders' segments are told once a zone
    borders = F.flatten(F.transform(F.flatten("parts"), geo.segments))
    met = meeting(rows, prepared(zones).select("zone_id", "geom_type", "parts", "centre", "reach", borders.alias("borders"), *SIDES))
    met = met.where(F.col("ax").isNull() | ~_apart())
    straight, first, last = F.col("ax").isNotNull(), F.get("geometry", F.lit(0)), F.get("geometry", F.lit(1))
    _, x, y = geo.projection(F.col("centre.lon"), F.col("centre.lat"), *(F.col(c) for c in ("ax", "ay", "bx", "by")))
    crossing = straight & F.exists("borders", lambda s: geo.crosses(first, last, s["a"], s["b"]))
    hit = (
        F.when((F.col("geom_type") == "Point") & straight, geo.planar2(y, x, F.col("centre.lat"), F.col("centre.lon")) <= F.col("reach") * F.col("reach"))
        .when(F.col("geom_type") == "Point", geo.line_meets_circle(F.col("geometry"), F.col("centre"), F.col("reach")))
        .when(F.col("geom_type") == "LineString", F.exists(F.flatten("parts"), lambda r: geo.line_meets_line(F.col("geometry"), r)))
        .otherwise(crossing | geo.line_meets_parts(F.col("geometry"), F.col("parts")))
    )
    return met.where(hit).select("zone_id", "src", "dst", "ord")


def nodes_in_zones(graph: Graph, zones: DataFrame, least_degree: int = LEAST_DEGREE) -> DataFrame:
    """zone_id, id of nodes inside zones or on their border, of so large an out-degree at least."""
    busy = degrees(graph.edges).where(F.col("degree") >= least_degree)
    rows = graph.nodes.join(busy, "id").select("id", "lat", "lon", *(F.col(c).alias(n) for n, c in (("minx", "lon"), ("maxx", "lon"), ("miny", "lat"), ("maxy", "lat"))))
    met = meeting(rows, prepared(zones).select("zone_id", "geom_type", "parts", "centre", "reach", *SIDES))
    p = geo.point(F.col("lon"), F.col("lat"))
    hit = F.when(F.col("geom_type") == "Point", geo.planar2(F.col("lat"), F.col("lon"), F.col("centre.lat"), F.col("centre.lon")) <= F.col("reach") * F.col("reach")).when(F.col("geom_type") == "LineString", F.exists(F.flatten("parts"), lambda r: F.exists(geo.segments(r), lambda s: geo.on_segment(s["a"], s["b"], p)))).otherwise(F.exists("parts", lambda rings: geo.in_rings(p, rings)))
    return met.where(hit).select("zone_id", "id")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "dst").union(pairs.select("dst", "src")).distinct()


def hard_barriers(edges: DataFrame, lines: DataFrame, distance: float = BARRIER) -> DataFrame:
    """src, dst, both ways, of edges that come within `distance` degrees of a barrier (column line, an array of points); null and empty lines are skipped."""
    rows = edges.select("src", "dst", "geometry").withColumns(geo.box(F.col("geometry")))
    walls = lines.where(F.size("line") > 0).select("line", *(v.alias(k) for k, v in geo.box(F.col("line")).items()))
    walls = walls.withColumns({"minx": F.col("minx") - distance, "maxx": F.col("maxx") + distance, "miny": F.col("miny") - distance, "maxy": F.col("maxy") + distance})
    return both_ways(meeting(rows, walls).where(geo.lines_within(F.col("geometry"), F.col("line"), distance)))


def overlay(graph: Graph, zones: DataFrame, block_intersections: bool = True) -> tuple[DataFrame, DataFrame]:
    """The overlay (src, dst, blocked, penalty) of zones, and the nodes (id) they block.

    A zone blocks its edges both ways unless it is a flood zone whose penalty is below BLOCKING_PENALTY: those count the greatest penalty, 1 at least. Zones with a path block its edges, without a look at their geometry. Blocked pairs are blocked whatever their penalties."""
    plain = zones.where("path is null")
    inside = nodes_in_zones(graph, plain) if block_intersections else nodes_in_zones(graph, plain.limit(0))
    return overlay_pairs(graph.edges, zones), inside.select("id").distinct()


def overlay_pairs(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """The overlay alone. A pair is judged once for both its directions."""
    edges, plain = laid(edges), zones.where("path is null")
    mild = (F.col("block_type") == "flood") & F.col("penalty").isNotNull() & (F.col("penalty") < BLOCKING_PENALTY)
    hit = _hits(edges, plain).join(plain.select("zone_id", F.coalesce(mild, F.lit(False)).alias("mild"), "penalty"), "zone_id")
    hit = hit.select("src", "dst", (~F.col("mild")).alias("blocked"), F.when(F.col("mild"), F.col("penalty")).alias("penalty"))
    along = edges_of_paths(edges, zones.where("path is not null")).select("src", "dst", F.lit(True).alias("blocked"), F.lit(None).cast("double").alias("penalty"))
    pairs = hit.union(along).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    pairs = pairs.agg(F.max("blocked").alias("blocked"), F.greatest(F.lit(1.0), F.max("penalty")).alias("penalty"))
    return pairs.select(F.explode(both_orders("a", "b")).alias("p"), "blocked", "penalty").select("p.src", "p.dst", "blocked", "penalty")
