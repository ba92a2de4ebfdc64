"""Hand-made road networks with known answers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lanemesh.functions import geo, text
from lanemesh.functions.roads import coefficients, travel_time, weight
from lanemesh.operators import geocode, graph, paths, postings, spatial, zones
from lanemesh.plans.service import Engine, validated
from lanemesh.schemas import OSM_NODES, OSM_WAYS, REQUESTS, ZONES, Graph, OsmData
from lanemesh.sources import osm

PLACES = {1: (21.000, 105.860), 2: (21.000, 105.861), 3: (21.000, 105.862), 4: (21.001, 105.860), 5: (21.001, 105.861), 6: (21.001, 105.862), 7: (21.000, 105.863), 8: (21.005, 105.870)}


def data(spark, ways, extra=()):
    """ways: (nodes, tags)."""
    nodes = spark.createDataFrame([(i, a, b, {}) for i, (a, b) in PLACES.items()] + list(extra), OSM_NODES)
    return OsmData(nodes, spark.createDataFrame([(100 + k, n, t, k) for k, (n, t) in enumerate(ways)], OSM_WAYS))


def road(kind, **more):
    return {"highway": kind, **more}


def costs(g, start, weather="normal", overlay=None, blocked=None):
    spark = g.edges.sparkSession
    found = paths.shortest(paths.weighted(g.edges, weather, overlay, blocked), spark.createDataFrame([(start,)], "node long"))
    return {r.node: r.cost for r in found.collect()}


@pytest.fixture(scope="module")
def two_roads(spark):
    g = graph.build_raw_graph(data(spark, [([1, 2, 3, 6], road("primary")), ([1, 4, 5, 6], road("residential"))]))
    return type(g)(g.nodes.cache(), g.edges.cache())


def test_haversine(spark):
    c = lambda *x: spark.range(1).select(geo.haversine(*map(F.lit, x)).alias("d")).first().d
    assert abs(c(*PLACES[1], *PLACES[2]) - 103.809407) < 1e-5
    assert abs(c(*PLACES[1], *PLACES[8]) - 1177.586935) < 1e-5


@pytest.mark.parametrize("weather,cost", [("normal", 255.050993), ("rain", 306.061191), ("flood", 357.071390)])
def test_primary_road_wins(two_roads, weather, cost):
    assert abs(costs(two_roads, 1, weather)[6] - cost) < 1e-5


def test_penalties_and_blocks(spark, two_roads):
    over = spark.createDataFrame([(1, 2, False, 1.6)], "src long, dst long, blocked boolean, penalty double")
    assert abs(costs(two_roads, 1, overlay=over)[6] - 304.879508) < 1e-5
    shut = spark.createDataFrame([(1, 2, True, None)], "src long, dst long, blocked boolean, penalty double")
    assert abs(costs(two_roads, 1, overlay=shut)[6] - 382.574820) < 1e-5
    inside = spark.createDataFrame([(2,), (5,)], "id long")
    assert 6 not in costs(two_roads, 1, blocked=inside)


def test_route_flips_only_in_flood(spark):
    g = graph.build_raw_graph(data(spark, [([1, 2], road("residential")), ([1, 4, 5, 2], road("primary"))]))
    ask = spark.createDataFrame([(1, 1, 2)], "request_id long, start long, goal long")
    lengths = {w: paths.routes(g, ask, w).first().path for w in ("normal", "rain", "flood")}
    assert lengths == {"normal": [1, 2], "rain": [1, 2], "flood": [1, 4, 5, 2]}
    got = paths.routes(g, ask).first()
    assert abs(got.distance - 103.809407) < 1e-5 and abs(got.duration - 103.809407 / 1000 / 30 * 3600) < 1e-5
    assert paths.routes(g, ask, size=1).first().path == [1, 2] and abs(paths.route_costs(g, ask, size=1).first().cost - got.cost) < 1e-9


def test_oneway_directions(spark):
    g = graph.build_raw_graph(data(spark, [([1, 2], road("primary", oneway="yes")), ([2, 3], road("primary", oneway="-1")), ([3, 6], road("primary")), ([6, 99], road("primary")), ([7, 8], road("footway"))]))
    assert {(r.src, r.dst) for r in g.edges.collect()} == {(1, 2), (3, 2), (3, 6), (6, 3)}


def test_closed_way_has_a_point_pair_per_segment(spark):
    g = graph.build_raw_graph(data(spark, [([1, 2, 5, 4, 1], road("primary", oneway="yes"))]))
    assert {(r.src, r.dst, len(r.geometry)) for r in g.edges.collect()} == {(1, 2, 2), (2, 5, 2), (5, 4, 2), (4, 1, 2)}


def test_largest_component_leaves_one_way_spurs_out(spark):
    g = graph.build_raw_graph(data(spark, [([1, 2, 3, 6], road("residential")), ([6, 8], road("residential", oneway="yes"))]))
    assert {r.id for r in graph.largest_component(g).collect()} == {1, 2, 3, 6}
    report = graph.component_report(g).first()
    assert (report.kept, report.percent >= 50) == (4, True)


def test_chain_becomes_an_edge(spark):
    ways = [([1, 2, 3, 6], road("residential", name="Long")), ([1, 4], road("primary")), ([1, 8], road("primary")), ([6, 7], road("primary")), ([6, 5], road("primary"))]
    out = graph.compress(graph.build_raw_graph(data(spark, ways))).edges
    row = out.where("src = 1 and dst = 6").first()
    assert abs(row.length - 318.813741) < 1e-5 and len(row.geometry) == 4 and (row.way_id, row.name) == (100, "Long")


@pytest.mark.parametrize("first,kept", [("chain", 1), ("direct", 2)])
def test_direct_edge_stays_only_if_it_comes_first(spark, first, kept):
    chain, direct = ([1, 2, 3], road("residential")), ([1, 3], road("residential"))
    ends = [([1, 4], road("primary")), ([1, 8], road("primary")), ([3, 7], road("primary")), ([3, 6], road("primary"))]
    g = graph.build_raw_graph(data(spark, ([chain, direct] if first == "chain" else [direct, chain]) + ends))
    assert graph.compress(g).edges.where("src = 1 and dst = 3").count() == kept


def test_compression_keeps_distances(spark):
    g = graph.build_raw_graph(data(spark, [([1, 2, 3, 6], road("residential")), ([1, 4], road("primary")), ([1, 8], road("primary")), ([6, 7], road("primary")), ([6, 5], road("primary"))]))
    before, after = costs(g, 1), costs(graph.compress(g), 1)
    assert set(after) == {1, 4, 8, 6, 7, 5}
    assert all(abs(before[n] - c) < 1e-6 for n, c in after.items())


def test_last_duplicate_node_wins(spark, tmp_path):
    doc = {"elements": [{"type": "node", "id": 9, "lat": 1.0, "lon": 2.0, "tags": {"name": "x"}}, {"type": "node", "id": 9, "lat": 1.0, "lon": 2.0}, {"type": "way", "id": 5, "nodes": [9]}, {"type": "relation", "id": 1}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    got = osm.read_json(spark, str(tmp_path / "a.json"))
    assert [r.tags for r in got.nodes.collect()] == [{}]
    assert [(r.id, r.nodes, r.tags) for r in got.ways.collect()] == [(5, [9], {})]
    landed = []
    ask = lambda q: (landed.append(q), str(tmp_path / "a.json"))[1]
    box = (20.9, 105.8, 21.1, 105.9)
    assert osm.fetch(spark, box, str(tmp_path / "cache"), [lambda q: None, ask]).nodes.count() == 1
    assert osm.fetch(spark, box, str(tmp_path / "cache")).nodes.count() == 1 and len(landed) == 1
    assert osm.fetch_area(spark, "Nowhere", str(tmp_path / "cache")) is None
    assert "motorway" in landed[0] and "addr:housenumber" in landed[0]


def test_nearest_by_degrees_and_by_metres_differ(spark):
    nodes = spark.createDataFrame([(1, 21.00100, 105.86), (2, 21.0, 105.86102)], "id long, lat double, lon double")
    point = spark.createDataFrame([(0, 21.0, 105.86)], "point_id long, lat double, lon double")
    assert spatial.nearest_nodes(point, nodes).first().node_id == 1
    got = spatial.nearest_nodes(point, nodes, metric="haversine").first()
    assert got.node_id == 2 and abs(got.distance - 105.886) < 1e-2
    assert spatial.snap(point, nodes, 100).count() == 0 and spatial.snap(point, nodes, 110).first().node_id == 2
    far = spark.createDataFrame([(0, -40.0, 10.0)], "point_id long, lat double, lon double")
    assert spatial.nearest_nodes(far, nodes).count() == 1


def test_projection_on_an_edge(spark):
    g = graph.build_raw_graph(data(spark, [([1, 2], road("primary"))]))
    point = spark.createDataFrame([(0, 21.0003, 105.86025), (1, 21.01, 105.86)], "point_id long, lat double, lon double")
    got = spatial.nearest_edges(point, g).collect()
    assert len(got) == 1 and abs(got[0].t - 0.25) < 1e-6 and abs(got[0].distance - 33.358478) < 1e-3
    v = spatial.virtual_nodes(point, g).first()
    assert abs(v.neighbours[0].dist - 25.952352) < 1e-3 and abs(v.neighbours[1].dist - 77.857055) < 1e-3 and v.source == "interpolated"
    nodes = spatial.virtual_nodes(point, g).select(F.lit(-5).cast("long").alias("vid"), "lat", "lon", "neighbours")
    ask = spark.createDataFrame([(1, -5, 2)], "request_id long, start long, goal long")
    assert abs(paths.virtual_routes(g, nodes, ask).first().distance - 77.857055) < 1e-3


def zone(spark, feature, **more):
    rows = [(1, 1, json.dumps(feature) if not isinstance(feature, str) else feature)]
    return spatial.parse_zones(spark.createDataFrame(rows, "zone_id long, ord long, feature string"))


def square(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]


def test_zone_geometry(spark, two_roads):
    def hit(feature):
        return {(r.src, r.dst) for r in spatial.edges_in_zones(two_roads.edges, zone(spark, feature)).collect()}

    polygon = {"type": "Polygon", "coordinates": [square(105.8602, 20.9999, 105.8604, 21.0001)]}
    assert hit({"type": "Feature", "properties": {}, "geometry": polygon}) == {(1, 2), (2, 1)} == hit(polygon)
    holed = {"type": "Polygon", "coordinates": [square(105.85, 20.99, 105.87, 21.01), square(105.8595, 20.9995, 105.8625, 21.0015)]}
    assert hit(holed) == set()
    touching = {"type": "Polygon", "coordinates": [square(105.8602, 21.0, 105.8604, 21.0005)]}
    assert hit(touching) == {(1, 2), (2, 1)}
    multi = {"type": "MultiPolygon", "coordinates": [[square(105.0, 20.0, 105.1, 20.1)], [square(105.8602, 20.9999, 105.8604, 21.0001)]]}
    assert hit(multi) == {(1, 2), (2, 1)}
    circle = lambda r: {"type": "Feature", "properties": {"radius": r}, "geometry": {"type": "Point", "coordinates": [105.8605, 20.9995]}}
    assert hit(circle(60)) == {(1, 2), (2, 1)} and hit(circle(50)) == set() == hit(circle(0))
    line = {"type": "LineString", "coordinates": [[105.8605, 20.999], [105.8605, 21.0005]]}
    assert hit(line) == {(1, 2), (2, 1)}
    assert zone(spark, "{broken").count() == 0


def test_overlay_rules(spark, two_roads):
    shape = {"type": "Polygon", "coordinates": [square(105.8602, 20.9999, 105.8604, 21.0001)]}

    def over(**properties):
        pairs, _ = spatial.overlay(two_roads, zone(spark, {"type": "Feature", "properties": properties, "geometry": shape}))
        return {(r.src, r.dst, r.blocked, r.penalty) for r in pairs.collect()}

    both = lambda b, p: {(1, 2, b, p), (2, 1, b, p)}
    assert over() == both(True, 1.0) == over(blockType="flood", penalty=100) == over(blockType="flood", penalty=None)
    assert over(blockType="flood") == both(False, 15.0)
    assert over(blockType="flood", penalty=0.2) == both(False, 1.0)
    path = zone(spark, {"type": "Feature", "properties": {"path": [1, 2, 8]}, "geometry": None})
    pairs, _ = spatial.overlay(two_roads, path)
    assert {(r.src, r.dst) for r in pairs.where("blocked").collect()} == {(1, 2), (2, 1)}


def test_barriers_block_both_ways(spark, two_roads):
    line = F.array(geo.point(F.lit(105.8605), F.lit(20.99)), geo.point(F.lit(105.8605), F.lit(21.0)))
    lines = spark.range(2).select(F.when(F.col("id") == 0, line).alias("line"))
    assert {(r.src, r.dst) for r in spatial.hard_barriers(two_roads.edges, lines).collect()} == {(1, 2), (2, 1)}


NAMES = ["Phố Lĩnh Nam", "Đường Minh Khai", "88 Phố Lạc Trung", "Ngõ 77 Phố Kim Ngưu", "Lĩnh Nam Phố", "Phố Lĩnh Hưng", "O'Brien"]


@pytest.fixture(scope="module")
def names(spark):
    rows = [(i, i, 0.0, 0.0, n, None, None, "poi", 80.0) for i, n in enumerate(NAMES, 1)]
    return spark.createDataFrame(rows, "id long, node_id long, lat double, lon double, address string, house_number string, street_name string, address_type string, rank_score double")


def test_phrases_and_relevance(spark, names):
    asked = ["pho linh", "Pho Linh Na", "linh", "duong", "đường", "nam pho", "77", "-"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    found = {}
    for r in postings.phrase_search(postings.build(names), q).collect():
        found.setdefault(asked[r.query_id], {})[r.id] = round(r.relevance, 6)
    assert found["pho linh"] == {1: 0.81754, 6: 0.81754}
    assert set(found["Pho Linh Na"]) == {1} and abs(found["Pho Linh Na"][1] - 1.5204232) < 1e-5
    assert len(found["linh"]) == 3 and abs(found["linh"][1] - 0.2605842) < 1e-5
    assert "duong" not in found and set(found["đường"]) == {2} and set(found["nam pho"]) == {5} and set(found["77"]) == {4} and "-" not in found


def test_search_phases(spark, names):
    q = spark.createDataFrame([(1, "pho linh"), (2, "ham"), (3, "minh khia"), (4, "x"), (5, "gõ 7")], "query_id long, query string")
    got = [(r.query_id, r.phase, r.id) for r in geocode.search(names, q, 3).collect()]
    assert {(1, 1, 1), (1, 1, 6), (5, 2, 4), (3, 3, 2)} <= set(got)
    assert not any(g[0] == 4 for g in got)
    per = {}
    for r in geocode.search(names, q, 3).collect():
        per.setdefault(r.query_id, []).append((r.place, r.node_id))
    assert all(len(v) <= 3 and len({n for _, n in v}) == len(v) for v in per.values())


def test_partial_ratio():
    assert text.partial_ratio_of("red", "a red widget") == 100.0
    assert text.partial_ratio_of("", "") == 100.0 and text.partial_ratio_of(None, "x") == 0.0
    assert 60 < text.partial_ratio_of("wiget", "widget") < 100


def test_search_joins_find_all_pairs(spark):
    rng = random.Random(5)
    addresses = [(i, "".join(rng.choice("abcdeé' %") for _ in range(rng.randint(0, 14)))) for i in range(60)] + [(60, None), (61, "ABCDE"), (62, "a" * 3000)]
    asked = [(f"q{i}", "".join(rng.choice("abcdeE'_%") for _ in range(rng.randint(1, 6)))) for i in range(40)] + [("n", None)]
    index, queries = spark.createDataFrame(addresses, "id long, address string"), spark.createDataFrame(asked, "query_id string, query string")
    all_ = queries.crossJoin(index)
    like = {(r.query_id, r.id) for r in all_.where(text.contains_like(F.col("address"), F.col("query"))).collect()}
    got = [(r.query_id, r.id) for r in geocode.like_matches(index, queries).collect()]
    assert len(got) == len(set(got)) and set(got) == like and any(len(dict(asked)[q]) > 3 for q, _ in like)
    whole = queries.where("query is not null")
    scores = {(q, i): text.partial_ratio_of(t.lower(), a.lower()) for q, t in asked if t for i, a in addresses if a}
    fuzzy = {(r.query_id, r.id): r.score for r in geocode.fuzzy_matches(index, whole).collect()}
    assert fuzzy == {k: v for k, v in scores.items() if v > text.FUZZY_ABOVE}
    assert geocode.fuzzy_matches(index.limit(0), whole).count() == 0 and geocode.like_matches(index.limit(0), queries).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_and_paths_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 40
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(50)} | {(n + i, n + i + 1) for i in range(12)} | {(n + 12, n + 3)})
    far = {a: {a} for a in range(n + 13)}
    for _ in range(n):
        for a, b in pairs:
            far[a] |= far[b]
        for a in far:
            far[a] = set().union(*(far[b] for b in far[a]))
    want = {a: min(b for b in far[a] if a in far[b]) for a in far}
    edges = spark.createDataFrame([(a, b, 1.0 + (a * 7 + b) % 5, i) for i, (a, b) in enumerate(pairs)], "src long, dst long, weight double, ord long")
    nodes = spark.createDataFrame([(a, 21.0, 105.0) for a in far], "id long, lat double, lon double")
    got = {r.id: r.component for r in graph.strong_components(Graph(nodes, edges)).collect()}
    assert got == want
    size = {c: sum(v == c for v in want.values()) for c in want.values()}
    most = min(size, key=lambda c: (-size[c], c))
    assert {r.id for r in graph.largest_component(Graph(nodes, edges)).collect()} == {a for a, c in want.items() if c == most}
    costs = paths.shortest(edges, spark.createDataFrame([(0, n)], "k long, node long"), ("k",))
    found = {r.node: r.cost for r in costs.collect()}
    assert set(found) == far[n]
    hops = paths.trace(paths.parents(edges, costs, ("k",)), spark.createDataFrame([(0, n + 12), (1, n)], "k long, node long"), ("k",)).collect()
    assert sorted((r.step, r.edge.src) for r in hops) == sorted((11 - i, n + i) for i in range(12))
    empty = Graph(nodes.limit(0), edges.limit(0))
    assert graph.strong_components(empty).count() == 0 and graph.largest_component(Graph(nodes, edges.limit(0))).collect()[0].id == 0


def test_only_joints_lose_a_vertex(spark):
    p = lambda x, y=0.0: {"lon": x, "lat": y}
    lines = [[p(0.0), p(0.0), p(1.0)], [p(1.0 + 1e-8), p(2.0)], [p(3.0), p(4.0)], [p(4.0)]]
    r = spark.createDataFrame([(lines,)], "lines array<array<struct<lon:double,lat:double>>>").select(paths.joined_geometry(F.col("lines")).alias("g")).first()
    assert [x.lon for x in r.g] == [0.0, 0.0, 1.0, 2.0, 3.0, 4.0]


def test_parse_address(spark):
    rows = [("88 Phố X", 88, "Phố X"), ("Phố X", None, "Phố X"), ("Ngõ 77 Phố Y", None, "Ngõ 77 Phố Y"), ("88", None, "88"), ("  7   A ", 7, "A")]
    got = spark.createDataFrame([(r[0],) for r in rows], "t string").select(text.house_number_of(F.col("t")).alias("n"), text.street_of(F.col("t")).alias("s")).collect()
    assert [(r.n, r.s) for r in got] == [r[1:] for r in rows]


def test_interpolation(spark):
    rows = [(1, 1, 21.000, 105.0, "10 S", "10", "S"), (2, 2, 21.001, 105.0, "20 S", "20", "S"), (3, 3, 29.0, 105.0, "12A S", "12A", "S")]
    addresses = spark.createDataFrame(rows, "id long, node_id long, lat double, lon double, address string, house_number string, street_name string")
    asked = spark.createDataFrame([(1, 15, "S"), (2, 10, "S"), (3, 5, "S"), (4, 25, "S"), (5, 1, "T")], "query_id long, house_number int, street string")
    got = {r.query_id: (round(r.lat, 6), r.method) for r in geocode.interpolate(addresses, asked).collect()}
    assert got == {1: (21.0005, "interpolated"), 2: (21.0, "exact"), 3: (21.0, "fallback_upper"), 4: (21.001, "fallback_lower")}


def test_place_beyond_the_cutoff_suppresses_none(spark):
    g = graph.build_raw_graph(data(spark, [([1, 2], road("primary"))]))
    points = spark.createDataFrame([(50, 21.00135, 105.860, None, None, "Cafe"), (51, 21.00045, 105.860, None, None, "Cafe"), (52, 21.0, 105.861, None, None, "Cafe")], "id long, lat double, lon double, house_number string, street string, name string")
    entries, centroids = geocode.streets(data(spark, [([1, 2], road("primary", name="Main"))]), g.nodes)
    got = [(r.address, r.node_id, r.address_type) for r in geocode.build_addresses(entries, centroids, points, g.nodes).orderBy("id").collect()]
    assert got == [("Main", 1, "street"), ("Cafe", 1, "poi")]


def test_zone_table(spark, tmp_path):
    t = zones.ZoneTable(spark, str(tmp_path / "zones"))
    rows = spark.createDataFrame([("a", '{"type":"Point","coordinates":[1,2]}', 7.0), ("b", "broken", None)], "name string, geometry string, severity double")
    assert t.create(rows) == [1, 2]
    assert t.update(1, name="c", severity=None) and not t.update(9, name="x") and not t.update(1)
    assert t.update(2, is_active=False) and [r.name for r in t.read(False).collect()] == ["c"]
    assert {r.severity for r in t.read().collect()} == {7.0, 5.0}
    assert t.delete(2) and not t.delete(2)
    assert t.create(rows.limit(1)) == [3]
    f = [json.loads(r.feature) for r in zones.features(t.read()).collect()]
    assert {x["properties"]["name"] for x in f} == {"a", "c"} and all(x["properties"]["blockType"] == "flood" for x in f)


def test_two_writers_of_zones(spark, tmp_path):
    at = str(tmp_path / "zones")
    a, b = zones.ZoneTable(spark, at), zones.ZoneTable(spark, at)
    one = lambda n: spark.createDataFrame([(n, "{}")], "name string, geometry string")
    a.create(one("first"))
    begun = a._claim(1)  # a has claimed a version and an id, and hasn't written yet
    assert b.create(one("second")) == [3] and b.update(1, severity=9.0)
    assert [r.id for r in b.read().orderBy("id").collect()] == [1, 3]
    assert b.compact() == 1  # up to the version that a may still write
    a._append(zones.created(one("late"), begun[1]).withColumn("op", F.lit("create")), begun[0])
    rows = {r.id: (r.name, r.severity) for r in b.read().collect()}
    assert rows == {1: ("first", 9.0), 2: ("late", 5.0), 3: ("second", 5.0)}
    assert a.compact() == 4 and a.compact() == 4 and {r.id: (r.name, r.severity) for r in b.read().collect()} == rows
    gone = a._claim(0)
    assert a.create(one("x")) == [4] and a.compact(lease=0.0) == 6
    with pytest.raises(Exception, match="exist"):
        b._append(spark.createDataFrame([], zones.CHANGE), gone[0])
    assert a.delete(1) and not b.update(1, name="y") and a.compact() == 7
    b.apply(spark.createDataFrame([("update", 1, "back")], "op string, id long, name string"))
    assert {r.id for r in a.read().collect()} == {2, 3, 4}
    assert sorted(n for n in a._names("base")) == ["b6", "b7"]


def test_writers_at_once_claim_different_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    t = zones.ZoneTable(spark, str(tmp_path / "zones"))
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda n: t._claim(n), range(1, 25)))
    assert sorted(v for v, _ in got) == list(range(1, 25))
    spans = sorted((mark, mark + n) for n, (_, mark) in zip(range(1, 25), got, strict=True))
    assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and spans[-1][1] == sum(range(1, 25))


def test_zone_stream(spark, tmp_path):
    from lanemesh.streaming.zones import CHANGES, change_counts, follow

    t = zones.ZoneTable(spark, str(tmp_path / "zones"))
    t.create(spark.createDataFrame([("a", "{}"), ("b", "{}")], "name string, geometry string"))
    lines = [{"op": "update", "id": 1, "name": "new", "ts": "2024-01-01T00:01:00Z"}, {"op": "update", "id": 1, "name": "old", "ts": "2024-01-01T00:00:00Z"}, {"op": "delete", "id": 2, "ts": "2024-01-01T00:02:00Z"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, lines)))
    stream = spark.readStream.schema(CHANGES).json(str(tmp_path / "in"))
    follow(stream, t, str(tmp_path / "check")).awaitTermination()
    assert [r.name for r in t.read().collect()] == ["new"]
    at = t._latest()
    t.apply(spark.createDataFrame([("delete", 1)], "op string, id long"), tag=f"{tmp_path / 'check'}#0")  # a batch that comes again
    assert t._latest() == at and t.read().count() == 1
    counted = change_counts(spark.read.schema(CHANGES).json(str(tmp_path / "in")))
    assert {(r.op, r.n) for r in counted.collect()} == {("update", 2), ("delete", 1)}


def test_requests_are_validated(spark):
    rows = [
        (1, "node", 1, None, None, None, "node", 6, None, None, None, "normal"),
        (2, "address", None, None, None, " x ", "node", 6, None, None, None, None),
        (3, "coords", None, 95.0, 1.0, None, "node", 6, None, None, None, None),
        (4, "coords", None, 1.0, 181.0, None, "node", 6, None, None, None, None),
        (5, "node", 1, None, None, None, "node", 6, None, None, None, "snow"),
        (6, "coords", None, 1.0, None, None, "node", 6, None, None, None, None),
    ]
    got = {r.request_id: r.error for r in validated(spark.createDataFrame(rows, REQUESTS)).collect()}
    assert got[1] is None and all(got[i] for i in range(2, 7))


def test_engine_end_to_end(spark):
    tags = {"addr:housenumber": "12", "addr:street": "Main"}
    d = data(spark, [([1, 2, 3, 6], road("primary", name="Main")), ([1, 4, 5, 6], road("residential", name="Side")), ([2, 5], road("tertiary"))], [(70, 21.0001, 105.861, tags)])
    e = Engine.load(spark, d)
    health = e.health().first()
    assert health.status == "ok" and health.node_count >= 4
    assert {(r.address_type, r.n) for r in e.geocoding_stats().collect()} >= {("street", 2), ("house", 1)}
    rows = [
        (1, "node", 1, None, None, None, "node", 6, None, None, None, "normal"),
        (2, "coords", None, 21.0001, 105.86, None, "address", None, None, None, "12 Main", "flood"),
        (3, "node", 1, None, None, None, "node", 1, None, None, None, "normal"),
        (4, "node", 12345, None, None, None, "node", 1, None, None, None, "normal"),
    ]
    rows = spark.createDataFrame(rows, REQUESTS)
    got = {r.request_id: r for r in e.route(rows).collect()}
    assert got[1].error is None and got[1].path[0] == 1 and got[1].path[-1] == 6 and json.loads(got[1].route)["geometry"]["type"] == "LineString"
    assert got[2].error is None and got[3].error and got[4].error
    wall = {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[105.8605, 20.99], [105.8605, 21.0005]]}}
    shut = {r.request_id: r for r in e.route(rows, blocking=spark.createDataFrame([(json.dumps(wall),)], "feature string")).collect()}
    assert shut[1].minutes > got[1].minutes and shut[1].affected_edges > 0 and shut[1].path != got[1].path
    with pytest.raises(ValueError):
        e.suggest(spark.createDataFrame([(1, "ma")], "query_id long, query string"), 21)


def test_coefficients_order(spark):
    rows = coefficients(spark, "flood").collect()
    assert len(rows) == 14 and [r.total for r in rows] == sorted(r.total for r in rows) and rows[0].highway_type == "motorway"


def test_times_and_weights(spark, two_roads):
    r = two_roads.edges.where("src = 1 and dst = 2").select(travel_time().alias("t"), weight("rain").alias("w")).first()
    assert abs(r.t - 103.809407 / 1000 / 60 * 3600) < 1e-5 and abs(r.w - 103.809407 * 0.8 * 1.2) < 1e-5


def test_zone_schema_matches_parsing(spark):
    z = zone(spark, {"type": "Point", "coordinates": [1, 2]})
    assert [f.name for f in z.schema] == [c.split(" ")[0].strip() for c in ZONES.split(", ")]
