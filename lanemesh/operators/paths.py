"""Shortest paths over a weighted edge table: batches of sources, batches of requests, and virtual end points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanemesh.functions.geo import consecutive, haversine, point
from lanemesh.functions.roads import ROAD_CLASSES, weight
from lanemesh.lineage import cut
from lanemesh.operators import balls, cells
from lanemesh.operators.graph import line_string
from lanemesh.operators.rounds import lowest
from lanemesh.schemas import Graph

#: Least weight of a metre, so that this share of the distance never overestimates a cost.
HEURISTIC = 0.7
VIRTUAL_SPEED = 30.0


def heuristic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return HEURISTIC * haversine(lat1, lon1, lat2, lon2)


def weighted(edges: DataFrame, weather: str = "normal", overlay: DataFrame | None = None, blocked_nodes: DataFrame | None = None) -> DataFrame:
    """edges with the column weight; without blocked pairs and edges into blocked nodes (column id), penalties multiplied in. overlay: src, dst, blocked, penalty."""
    out = edges.where("src != dst")
    if overlay is not None:
        one = overlay.groupBy("src", "dst").agg(F.max("blocked").alias("blocked_"), F.greatest(F.lit(1.0), F.max("penalty")).alias("penalty_"))
        out = out.join(one, ["src", "dst"], "left").where(~F.coalesce("blocked_", F.lit(False)))
        out = out.withColumn("weight", weight(weather) * F.coalesce("penalty_", F.lit(1.0))).drop("blocked_", "penalty_")
    else:
        out = out.withColumn("weight", weight(weather))
    if blocked_nodes is not None:
        out = out.join(blocked_nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti")
    return out


def shortest(edges: DataFrame, sources: DataFrame, keys: tuple[str, ...] = (), targets: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """keys, node, cost from each source: rows of keys and node, and their start cost if there is a column cost.

    edges: src, dst, weight, and the keys if they differ by key. Each round relaxes the edges of nodes whose cost fell, and writes those alone. With keys, targets (keys, node) and nodes, what can't beat the best cost of a target of its key any more isn't followed."""
    columns = [*keys, "node"]
    per_key = [k for k in keys if k in edges.columns]
    steps = cut(edges.groupBy(*per_key, "src", "dst").agg(F.min("weight").alias("weight")))
    start = F.col("cost") if "cost" in sources.columns else F.lit(0.0)
    goal = None
    if targets is not None and keys:
        goal = targets.join(nodes.select(F.col("id").alias("node"), F.col("lat").alias("glat"), F.col("lon").alias("glon")), "node")
        goal = cut(goal.select(*columns, "glat", "glon"))

    def hopeful(frontier: DataFrame, state: DataFrame) -> DataFrame:
        best = state.join(goal.select(*columns), columns, "left_semi").groupBy(*columns).agg(F.min("cost").alias("best"))
        ahead = goal.join(best, columns, "left").drop("node")
        near = frontier.join(ahead, list(keys)).join(nodes.select(F.col("id").alias("node"), "lat", "lon"), "node")
        # a little slack keeps ties that rounding would lose
        bound = F.col("cost") + heuristic(F.col("lat"), F.col("lon"), F.col("glat"), F.col("glon"))
        return near.where(F.col("best").isNull() | (bound <= F.col("best") * (1 + 1e-9))).select(*columns, "cost").distinct()

    def offers(frontier: DataFrame, state: DataFrame) -> DataFrame:
        live = hopeful(frontier, state) if goal is not None else frontier
        out = live.withColumnRenamed("node", "src").join(steps, [*per_key, "src"])
        return out.select(*keys, F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"))

    return lowest(sources.select(*columns, start.alias("cost")), columns, "cost", offers)


def parents(edges: DataFrame, costs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, parent and the edge (a struct) by which each node got its cost; ties by parent, then by the edge's ord."""
    per_key = [k for k in keys if k in edges.columns]
    edge = F.struct(*[c for c in edges.columns if c not in per_key])
    near = costs.select(*keys, F.col("node").alias("src"), F.col("cost").alias("before"))
    far = costs.select(*keys, F.col("node").alias("dst"), F.col("cost").alias("after"))
    met = near.join(edges.withColumn("edge", edge), [*per_key, "src"]).join(far, [*keys, "dst"])
    met = met.where((F.col("before") < F.col("after")) & (F.col("before") + F.col("weight") == F.col("after")))
    best = met.groupBy(*keys, "dst").agg(F.min_by(F.struct("src", "edge"), F.struct("src", "ord")).alias("b"))
    return best.select(*keys, F.col("dst").alias("node"), F.col("b.src").alias("parent"), F.col("b.edge").alias("edge"))


def trace(tree: DataFrame, ends: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, step, edge of the paths that end at `ends` (keys, node); step counts back from 0 at the end.

    Pointers are doubled: a round knows each node's ancestor 1, 2, 4, ... edges up, so rounds grow with the logarithm of the longest path."""
    tree = cut(tree)
    up = tree.select(*keys, "node", F.col("parent").alias("up"))
    on, length = cut(ends.select(*keys, "node", F.lit(0).alias("step"))), 1
    while True:
        more = cut(on.join(up, [*keys, "node"]).select(*keys, F.col("up").alias("node"), (F.col("step") + length).alias("step")))
        if more.first() is None:
            return on.join(tree, [*keys, "node"]).select(*keys, "step", "edge")
        on, length = on.union(more), 2 * length
        after = up.select(*keys, F.col("node").alias("up"), F.col("up").alias("next"))
        up = cut(up.join(after, [*keys, "up"]).select(*keys, "node", F.col("next").alias("up")))


def assemble(hops: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, path, geometry, distance, duration (seconds), edges of traced paths. Penalties and weather change neither distance nor duration."""
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("step", "edge"))))
    rows = hops.groupBy(*keys).agg(ordered.alias("hops")).withColumn("e", F.transform("hops", lambda h: h["edge"]))
    return rows.select(*keys, *path_columns(F.col("e")))


def path_columns(e: Column) -> list[Column]:
    """path, geometry, distance, duration, edges of an array of edge structs in travel order."""
    total = lambda f: F.aggregate(F.transform(e, f), F.lit(0.0), lambda s, x: s + x)
    nodes = F.concat(F.transform(F.slice(e, 1, 1), lambda x: x["src"]), F.transform(e, lambda x: x["dst"]))
    return [
        nodes.alias("path"),
        joined_geometry(F.transform(e, lambda x: x["geometry"])).alias("geometry"),
        total(lambda x: x["length"]).alias("distance"),
        total(lambda x: x["length"] / 1000 / x["speed"] * 3600).alias("duration"),
        F.size(e).alias("edges"),
    ]


def joined_geometry(lines: Column, tolerance: float = 1e-6) -> Column:
    """Lines one after another; where a line begins within the tolerance, on both axes, of the end of the one before, that point stays once."""
    far = lambda p, q: (F.abs(p["lon"] - q["lon"]) >= tolerance) | (F.abs(p["lat"] - q["lat"]) >= tolerance)
    before = F.concat(F.array(F.lit(None).cast("struct<lon:double,lat:double>")), F.transform(lines, lambda line: F.get(line, F.size(line) - 1)))
    pairs = F.arrays_zip(lines.alias("line"), F.slice(before, 1, F.size(lines)).alias("q"))
    met = lambda z: z["q"].isNotNull() & ~far(F.get(z["line"], F.lit(0)), z["q"])
    return F.flatten(F.transform(pairs, lambda z: F.when(met(z), F.slice(z["line"], 2, F.greatest(F.size(z["line"]) - 1, F.lit(0)))).otherwise(z["line"])))


def routes(graph: Graph, requests: DataFrame, weather: str = "normal", overlay: DataFrame | None = None, blocked_nodes: DataFrame | None = None, size: int = cells.CELL) -> DataFrame:
    """request_id, cost, path, geometry, distance, duration, edges of the cheapest paths of requests (request_id, start, goal) that have one, by searches of cells of about `size` nodes, or by balls if most edges lead to other cells."""
    edges = cut(weighted(graph.edges, weather, overlay, blocked_nodes))
    keys = ("request_id",)
    ask = cut(requests.select("request_id", "start", "goal").where("start != goal"))
    goals = ask.select("request_id", F.col("goal").alias("node"))
    own, rows = cells.placed(graph.nodes, edges, size)
    if cells.scattered(rows):
        return _by_balls(edges, rows, ask, goals)
    parts = cells.gathered(own, rows)
    found = cells.costs(parts, ask, HEURISTIC)
    reached = cut(found.join(goals, ["request_id", "node"], "left_semi").select("request_id", "node", F.col("at.cost").alias("cost")))
    tree = trace(cells.origins(parts, ask, found), reached, keys)
    steps = cells.legs(parts, ask, cut(tree))
    hops = steps.join(edges.select("ord", F.struct(*edges.columns).alias("edge")), "ord").select("request_id", "step", "edge")
    return reached.select("request_id", "cost").join(assemble(hops, keys), "request_id")


def _by_balls(edges: DataFrame, rows: DataFrame, ask: DataFrame, goals: DataFrame) -> DataFrame:
    """routes() of weighted edges from the balls over rows, their cheapest ones: costs from the start are carried on from where the balls meet to the goal, then the path is traced back."""
    keys = ("request_id",)
    state = balls.grown(rows, ask)
    near, far, met = balls.tight(edges.select("src", "dst", "weight", "ord"), state)
    onward = shortest(far, met, keys)
    costs = cut(state.where("not back").select(*keys, "node", "cost").union(onward).groupBy(*keys, "node").agg(F.min("cost").alias("cost")))
    reached = cut(costs.join(met.select(*keys).distinct(), list(keys), "left_semi").join(goals, [*keys, "node"], "left_semi"))
    steps = trace(parents(near.union(far).distinct(), costs, keys), reached, keys)
    hops = steps.select(*keys, "step", "edge.ord").join(edges.select("ord", F.struct(*edges.columns).alias("edge")), "ord").select(*keys, "step", "edge")
    return reached.select("request_id", "cost").join(assemble(hops, keys), "request_id")


def route_costs(graph: Graph, requests: DataFrame, weather: str = "normal", overlay: DataFrame | None = None, blocked_nodes: DataFrame | None = None, size: int = cells.CELL) -> DataFrame:
    """request_id and cost alone, as routes() has them."""
    edges = weighted(graph.edges, weather, overlay, blocked_nodes).select("src", "dst", "weight", "ord")
    ask = cut(requests.select("request_id", "start", "goal").where("start != goal"))
    own, rows = cells.placed(graph.nodes, edges, size)
    if cells.scattered(rows):
        return balls.best(balls.grown(rows, ask)).where("best is not null").select("request_id", F.col("best").alias("cost"))
    found = cells.costs(cells.gathered(own, rows), ask, HEURISTIC)
    return found.join(ask.select("request_id", F.col("goal").alias("node")), ["request_id", "node"], "left_semi").select("request_id", F.col("at.cost").alias("cost"))


def route_features(routes: DataFrame, weather: str = "normal") -> DataFrame:
    """routes with minutes and a GeoJSON feature."""
    feature = F.struct(F.lit("Feature").alias("type"), line_string(F.col("geometry")).alias("geometry"), F.struct(F.lit(weather).alias("weather")).alias("properties"))
    return routes.withColumns({"minutes": F.col("duration") / 60, "route": F.to_json(feature)})


def path_pairs(paths: DataFrame) -> DataFrame:
    """Consecutive nodes src, dst of the column path of zone_id rows."""
    return paths.select("zone_id", F.explode(consecutive("path")).alias("s")).select("zone_id", "s.src", "s.dst").where("dst is not null")


def edges_of_paths(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """zone_id, src, dst, both ways, of the paths' consecutive nodes that an edge joins in either direction."""
    least, greatest = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    pairs = path_pairs(paths).where("src is not null").select("zone_id", least, greatest)
    found = pairs.join(edges.select(least, greatest), ["a", "b"], "left_semi").distinct()
    return found.select("zone_id", F.explode(both_orders("a", "b")).alias("p")).select("zone_id", "p.src", "p.dst")


def both_orders(a: str, b: str) -> Column:
    """An array of structs src, dst: a pair each way, once if it is of one node."""
    one, other = (F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in ((a, b), (b, a)))
    return F.when(F.col(a) == F.col(b), F.array(one)).otherwise(F.array(one, other))


def with_virtual(graph: Graph, virtual: DataFrame, weather: str = "normal") -> tuple[Graph, DataFrame]:
    """The graph with virtual nodes (vid, lat, lon, neighbours: array of id, dist) joined by legs in both directions. Legs count their metres as cost and are driven at VIRTUAL_SPEED. Also the legs."""
    one = virtual.select(F.col("vid").alias("v"), "lat", "lon", F.explode("neighbours").alias("n"))
    near = one.join(graph.nodes.select(F.col("id").alias("nid"), F.col("lat").alias("nlat"), F.col("lon").alias("nlon")), F.col("n.id") == F.col("nid"))
    here, there = point(F.col("lon"), F.col("lat")), point(F.col("nlon"), F.col("nlat"))

    def leg(src, dst, line, step):
        return near.select(src.alias("src"), dst.alias("dst"), F.lit(-1).cast("long").alias("way_id"), F.col("n.dist").alias("length"), F.lit("virtual").alias("highway_type"), F.lit("").alias("name"), F.lit(VIRTUAL_SPEED).alias("speed"), F.lit(1.0).alias("c_highway"), line.alias("geometry"), (-F.abs(F.xxhash64("v", "nid")) - 1 - step).alias("ord"))

    legs = leg(F.col("v"), F.col("nid"), F.array(here, there), 0).union(leg(F.col("nid"), F.col("v"), F.array(there, here), 1))
    nodes = graph.nodes.union(virtual.select(F.col("vid").alias("id"), "lat", "lon"))
    return Graph(nodes, graph.edges.unionByName(legs)), legs


def virtual_routes(graph: Graph, virtual: DataFrame, requests: DataFrame, weather: str = "normal") -> DataFrame:
    """routes() whose start or goal may be a virtual node; both legs count."""
    whole, _ = with_virtual(graph, virtual, weather)
    return routes(Graph(cut(whole.nodes), cut(whole.edges)), requests, weather)


assert HEURISTIC <= min(r[1] for r in ROAD_CLASSES)
