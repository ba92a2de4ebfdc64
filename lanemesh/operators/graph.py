"""Building road graphs: segments, largest strongly connected component, contraction of chains, statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanemesh.functions.geo import consecutive, haversine, point
from lanemesh.functions.roads import base_coefficient, is_oneway, is_reverse_oneway, speed, tag
from lanemesh.lineage import cut
from lanemesh.operators.reach import condensed, reachable, without_ends
from lanemesh.operators.rounds import lowest
from lanemesh.schemas import Graph, OsmData
from lanemesh.sources.osm import used_nodes, valid_ways

#: Vertices of one way at most, so that an edge's place in adjacency order fits a long.
MOST_VERTICES = 1 << 20

EDGE_COLUMNS = ["src", "dst", "way_id", "length", "highway_type", "name", "speed", "c_highway", "geometry", "ord"]


def segments(ways: DataFrame) -> DataFrame:
    """Consecutive vertices of each way: way_id, ord, pos, src, dst and the way's columns of edges."""
    columns = ways.withColumns({"highway_type": tag("highway"), "name": F.coalesce(tag("name"), F.lit("")), "oneway_": is_oneway(), "reverse_": is_reverse_oneway()})
    rows = columns.select(F.col("id").alias("way_id"), "ord", "highway_type", "name", "oneway_", "reverse_", F.posexplode(consecutive("nodes")).alias("pos", "s"))
    return rows.select(*[c for c in rows.columns if c != "s"], "s.src", "s.dst").where("dst is not null")


def expand_directions(rows: DataFrame) -> DataFrame:
    """One row per direction of travel: forward, reverse or both; step 0 or 1 follows adjacency order. Columns src_x and dst_x turn with src and dst."""
    sides = [c[3:] for c in rows.columns if c == "src" or c.startswith("src_")]
    turned = lambda a, b, step: F.struct(*(F.col(a + c).alias("src" + c) for c in sides), *(F.col(b + c).alias("dst" + c) for c in sides), F.lit(step).alias("step"))
    forward, back = turned("src", "dst", 0), turned("dst", "src", 1)
    choice = F.when(F.col("reverse_"), F.array(back)).when(F.col("oneway_"), F.array(forward)).otherwise(F.array(forward, back))
    kept = [c for c in rows.columns if c[3:] not in sides or c[:3] not in ("src", "dst")]
    return rows.select(*kept, F.explode(choice).alias("d")).select(*kept, "d.*")


def build_raw_graph(data: OsmData, ways: DataFrame | None = None) -> Graph:
    """The multigraph of segments of valid ways; segments without both nodes go. Geometry is the two end points."""
    ways = valid_ways(data.ways) if ways is None else ways
    at = lambda side: data.nodes.select(F.col("id").alias(side), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))
    # a segment meets its nodes once for both directions
    rows = expand_directions(segments(ways).join(at("src"), "src").join(at("dst"), "dst"))
    rows = rows.withColumns(
        {
            "length": haversine(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon")),
            "speed": speed(F.col("highway_type")),
            "c_highway": base_coefficient(F.col("highway_type")),
            "geometry": F.array(point(F.col("src_lon"), F.col("src_lat")), point(F.col("dst_lon"), F.col("dst_lat"))),
            "ord": (F.col("ord") * MOST_VERTICES + F.col("pos")) * 2 + F.col("step"),
        }
    )
    return Graph(used_nodes(ways, data.nodes).select("id", "lat", "lon"), rows.select(*EDGE_COLUMNS))


def induced(graph: Graph, ids: DataFrame) -> Graph:
    """The nodes in ids (column id), and the edges between them."""
    return Graph(graph.nodes.join(ids, "id", "left_semi"), within(graph.edges, ids).select(*graph.edges.columns))


def degrees(edges: DataFrame) -> DataFrame:
    """id and out-degree, parallel edges counted."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def incident(edges: DataFrame) -> DataFrame:
    """Each edge from both its ends: id, neighbour, highway_type."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "highway_type").union(edges.select("dst", "src", "highway_type"))


def neighbourhoods(edges: DataFrame) -> DataFrame:
    """id, its distinct neighbours in either direction, and distinct classes of its edges."""
    return incident(edges).groupBy("id").agg(F.count_distinct("neighbour").alias("neighbours"), F.count_distinct("highway_type").alias("kinds"))


def parallel_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")


def statistics(graph: Graph) -> DataFrame:
    """One row: node_count, edge_count and bounds (zeros if empty)."""
    rows = graph.nodes.select("lat", "lon", F.lit(1).alias("n"), F.lit(0).alias("e")).union(graph.edges.select(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0), F.lit(1)))
    bounds = [F.coalesce(f(c), F.lit(0.0)).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"), F.coalesce(F.sum("e"), F.lit(0)).alias("edge_count"), *bounds)


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between nodes (column id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def around(edges: DataFrame, pivot: DataFrame) -> DataFrame:
    """Column id of the component of pivot: what it reaches and is reached by."""
    return cut(reachable(edges, pivot).join(reachable(edges, pivot, backward=True), "id", "left_semi"))


def coloured_components(nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """id, component (one id of it), of all components at once; None without nodes.

    A turn sets aside the nodes on no ring, each its own component. Every other one is coloured with the least id that reaches it; what reaches that id within its colour is a component, so that a turn finds one for each colour."""
    out = None
    while nodes.first() is not None:
        inner, edges = without_ends(nodes, edges)
        own = cut(nodes.join(inner, "id", "left_anti").select("id", F.col("id").alias("component")))
        out = own if out is None else out.union(own)
        if inner.first() is None:
            return out
        pass_on = lambda frontier, _: edges.join(frontier.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "component")  # noqa: B023, E731
        colour = lowest(inner.select("id", F.col("id").alias("component")), ["id"], "component", pass_on)
        at = lambda side: colour.select(F.col("id").alias(side), F.col("component").alias(f"{side}_"))  # noqa: B023, E731
        inside = edges.join(at("src"), "src").join(at("dst"), "dst").where("src_ = dst_").select("src", "dst")
        own = cut(reachable(inside, colour.where("id = component"), backward=True).join(colour, "id"))
        out = out.union(own)
        nodes = cut(inner.join(own, "id", "left_anti"))
        edges = cut(within(edges, nodes))
    return out


def strong_components(graph: Graph) -> DataFrame:
    """id, component (its least id): nodes that edges join both ways are one, then the largest of those with what is around it, then the rest all at once."""
    whole = condensed(graph.nodes, graph.edges)
    nodes, edges = without_ends(whole.nodes, whole.edges)
    found = whole.nodes.join(nodes, "id", "left_anti").select("id", F.col("id").alias("component"))
    pivot = cut(nodes.orderBy(F.desc("size"), "id").limit(1).select("id"))
    if pivot.first() is not None:
        own = around(edges, pivot)
        found = found.union(own.crossJoin(F.broadcast(pivot.withColumnRenamed("id", "component"))))
        nodes = cut(nodes.select("id").join(own, "id", "left_anti"))
        rest = coloured_components(nodes, cut(within(edges, nodes)))
        found = found if rest is None else found.union(rest)
    rows = cut(whole.members.join(found.withColumnRenamed("id", "top"), "top").select("id", "component"))
    return rows.join(rows.groupBy("component").agg(F.min("id").alias("least")), "component").select("id", F.col("least").alias("component"))


def largest_component(graph: Graph) -> DataFrame:
    """Column id of the largest strongly connected component; of several the one with the least id.

    Components are taken from the largest contracted node on, until no more nodes are left than the largest so far has."""
    whole = condensed(graph.nodes, graph.edges)
    nodes, edges = without_ends(whole.nodes, whole.edges)
    found = whole.nodes.join(nodes, "id", "left_anti").select("id", "size", F.col("id").alias("component"))
    best = found.agg(F.max("size")).first()[0] or 0
    while (nodes.agg(F.sum("size")).first()[0] or 0) >= max(best, 1):
        pivot = nodes.orderBy(F.desc("size"), "id").first().id
        own = cut(nodes.join(around(edges, nodes.where(F.col("id") == pivot).select("id")), "id", "left_semi").withColumn("component", F.lit(pivot)))
        best = max(best, own.agg(F.sum("size")).first()[0])
        found = found.union(own)
        nodes = cut(nodes.join(own, "id", "left_anti"))
        edges = cut(within(edges, nodes))
    rows = cut(whole.members.join(found.select(F.col("id").alias("top"), "component"), "top").select("id", "component"))
    most = rows.groupBy("component").agg(F.count("*").alias("n"), F.min("id").alias("least")).orderBy(F.desc("n"), "least").limit(1)
    return rows.join(most, "component", "left_semi").select("id")


def component_report(graph: Graph) -> DataFrame:
    """One row: components, nodes in the largest, nodes dropped, whole percent kept."""
    sizes = strong_components(graph).groupBy("component").agg(F.count("*").alias("n"))
    out = sizes.agg(F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("kept"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_"))
    return out.select("components", "kept", (F.col("all_") - F.col("kept")).alias("dropped"), F.floor(100 * F.col("kept") / F.greatest("all_", F.lit(1))).alias("percent"))


def contractible(edges: DataFrame) -> DataFrame:
    """Column id of the nodes with two distinct neighbours and one road class."""
    return neighbourhoods(edges).where("neighbours = 2 and kinds = 1").select("id")


def compress(graph: Graph) -> Graph:
    """Chains of contractible nodes become single edges, by pointer doubling.

    A chain goes on with the first edge, by ord, that doesn't turn back. It keeps the attributes of its first edge, the sum of lengths and the joined geometry, and is dropped unless it ends at a kept node. A direct edge stays only if it is the first, by ord, between its ends; chains all stay."""
    edges = cut(graph.edges)
    inner = cut(contractible(edges))
    ahead = edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("via"), F.col("dst").alias("to"), F.col("ord").alias("next"))
    into = edges.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select("ord", "src", F.col("dst").alias("via"))
    follow = into.join(ahead, "via").where("to != src").groupBy("ord").agg(F.min("next").alias("next"))
    chain = edges.join(follow, "ord", "left").select("ord", "next", F.col("dst").alias("head"), "length", "geometry", F.lit(1).cast("long").alias("hops"))
    chain = cut(chain)
    rounds = int(math.ceil(math.log2(inner.count() + 1))) + 1
    for _ in range(rounds):
        if chain.where("next is not null").first() is None:
            break
        after = chain.select(F.col("ord").alias("next"), F.col("next").alias("next2"), F.col("head").alias("head2"), F.col("length").alias("length2"), F.col("geometry").alias("geometry2"), F.col("hops").alias("hops2"))
        both = chain.join(after, "next", "left")
        more = F.col("next").isNotNull()
        chain = cut(
            both.select(
                "ord",
                F.col("next2").alias("next"),
                F.coalesce("head2", "head").alias("head"),
                F.when(more, F.col("length") + F.col("length2")).otherwise(F.col("length")).alias("length"),
                F.when(more, F.concat("geometry", F.slice("geometry2", F.lit(2), F.greatest(F.size("geometry2") - 1, F.lit(0))))).otherwise(F.col("geometry")).alias("geometry"),
                F.when(more, F.col("hops") + F.col("hops2")).otherwise(F.col("hops")).alias("hops"),
            )
        )
    first = edges.join(inner.withColumnRenamed("id", "src"), "src", "left_anti").drop("dst", "length", "geometry")
    whole = first.join(chain.where("next is null"), "ord").join(inner.withColumnRenamed("id", "head"), "head", "left_anti").withColumnRenamed("head", "dst")
    rank = F.row_number().over(W.partitionBy("src", "dst").orderBy("ord"))
    kept = whole.withColumn("rank_", rank).where("hops > 1 or rank_ = 1")
    nodes = graph.nodes.join(inner, "id", "left_anti")
    return Graph(nodes, kept.select(*EDGE_COLUMNS))


def build_graph(data: OsmData) -> Graph:
    """From map data to the compressed graph of the largest strongly connected component."""
    raw = build_raw_graph(data)
    raw = Graph(cut(raw.nodes), cut(raw.edges))
    out = compress(induced(raw, largest_component(raw)))
    return Graph(cut(out.nodes), cut(out.edges))


def modified(graph: Graph, blocked: DataFrame, multipliers: DataFrame) -> Graph:
    """The graph without blocked edges (src, dst), and with base coefficients multiplied (src, dst, multiplier)."""
    edges = graph.edges.join(blocked.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    edges = edges.join(multipliers.groupBy("src", "dst").agg(F.max("multiplier").alias("m_")), ["src", "dst"], "left")
    return Graph(graph.nodes, edges.withColumn("c_highway", F.col("c_highway") * F.coalesce("m_", F.lit(1.0))).select(*graph.edges.columns))


def line_string(geometry: Column) -> Column:
    """A GeoJSON LineString struct of an array of points."""
    return F.struct(F.lit("LineString").alias("type"), F.transform(geometry, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))


def edge_features(edges: DataFrame) -> DataFrame:
    """One GeoJSON feature per pair of nodes, whichever the direction; the first edge by ord wins."""
    row = F.struct("highway_type", "name", "length", "geometry")
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min_by(row, "ord").alias("e"))
    feature = F.struct(F.lit("Feature").alias("type"), line_string(F.col("e.geometry")).alias("geometry"), F.struct(F.col("e.highway_type").alias("highway"), F.col("e.name").alias("name"), F.col("e.length").alias("length")).alias("properties"))
    return pairs.select("a", "b", F.col("e.highway_type").alias("highway"), F.col("e.name").alias("name"), F.col("e.length").alias("length"), F.to_json(feature).alias("feature"))


def write_geojson(edges: DataFrame, path: str) -> None:
    """The features as newline-delimited GeoJSON text."""
    edge_features(edges).select("feature").write.mode("overwrite").text(path)
