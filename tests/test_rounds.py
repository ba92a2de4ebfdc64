"""Search over posting lists, reachability by contraction and paths over cells, against brute force."""

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lanemesh import lineage
from lanemesh.functions import geo, text
from lanemesh.operators import boxes, cells, geocode, graph, lookup, paths, postings, reach, spatial
from lanemesh.schemas import Graph

# Posting lists


def plain_hits(tokens, query):
    n = len(query)
    return sum(tokens[i : i + n - 1] == query[:-1] and tokens[i + n - 1].startswith(query[-1]) for i in range(len(tokens) - n + 1)) if n else 0


@pytest.mark.parametrize("piece", [1_000_000, 3])
def test_phrases_against_every_row(spark, monkeypatch, piece):
    monkeypatch.setattr(postings, "LIST", piece)
    rng = random.Random(piece)
    rows = [(i, " ".join(rng.choice(["la", "lab", "la", "l", "b", "é", "Lá", "x1"]) for _ in range(rng.randint(0, 12)))) for i in range(80)] + [(80, None), (81, "-"), (82, "la " * 400)]
    asked = [(i, " ".join(rng.choice(["la", "l", "b", "lab", "e", "x"]) for _ in range(rng.randint(1, 4)))) for i in range(60)] + [(60, "no such"), (61, None), (62, "la la la"), (63, "")]
    addresses = spark.createDataFrame(rows, "id long, address string")
    queries = spark.createDataFrame(asked, "query_id long, query string")
    index = postings.build(addresses)
    split = lambda df, c: {r[0]: r[1] for r in df.select(df.columns[0], text.tokens(F.col(c))).collect()}
    tokens, wanted = split(addresses, "address"), split(queries, "query")
    want = {(q, i): n for q, ask in wanted.items() for i, own in tokens.items() if (n := plain_hits(own, ask))}
    got = [(r.query_id, r.id, r.hits) for r in postings.phrase_search(index, queries).collect()]
    assert len(got) == len(want) and {(q, i): n for q, i, n in got} == want
    assert index.rows == len(rows) and abs(index.mean_length - sum(map(len, tokens.values())) / len(rows)) < 1e-12


def test_lists_stay_in_their_buckets(spark):
    addresses = spark.range(200).select("id", F.concat(F.lit("road "), F.col("id").cast("string")).alias("address"))
    index = postings.build(addresses)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = index.tokens.where("token = 'road'").withColumn("query_id", F.lit(1))
        plan = postings.lists_of(index, asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[plan.index("Bucketed: true") - 4000 if plan.index("Bucketed: true") > 4000 else 0 :]
    assert "Bucketed: true" in plan and scan.count("Exchange hashpartitioning") == 1 and "positions" in plan
    nothing = postings.build(addresses.limit(0))
    assert nothing.rows == 0 and postings.phrase_search(nothing, spark.createDataFrame([(1, "a b")], "query_id long, query string")).count() == 0


# Reachability


def tables(make):
    before = len(lineage._written)
    out = make()
    return out, len(lineage._written) - before


def test_a_long_one_way_chain_takes_few_rounds(spark):
    ids = list(range(2000))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame(list(itertools.pairwise(ids)), "src long, dst long")
    at = lambda k: spark.createDataFrame([(ids[k],)], "id long")
    found, rounds = tables(lambda: reach.reachable(edges, at(500)))
    assert {r.id for r in found.collect()} == set(ids[500:]) and rounds < 30
    assert {r.id for r in reach.reachable(edges, at(500), backward=True).collect()} == set(ids[:501])
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    found, rounds = tables(lambda: graph.strong_components(Graph(nodes, edges)))
    assert {(r.id, r.component) for r in found.collect()} == {(i, i) for i in ids} and rounds < 30


def test_a_long_road_and_a_long_ring(spark):
    ids = list(range(600))
    random.Random(2).shuffle(ids)
    nodes = spark.createDataFrame([(i,) for i in [*ids, 1000, 1001]], "id long")
    ahead = list(itertools.pairwise(ids))
    road = spark.createDataFrame(ahead + [(b, a) for a, b in ahead] + [(1000, 1001)], "src long, dst long")
    found, rounds = tables(lambda: graph.largest_component(Graph(nodes, road)))
    assert {r.id for r in found.collect()} == set(ids) and rounds < 60
    ring = spark.createDataFrame([*ahead, (ids[-1], ids[0]), (ids[3], 1000)], "src long, dst long")
    assert {r.id for r in graph.largest_component(Graph(nodes, ring)).collect()} == set(ids)
    assert {r.component for r in graph.strong_components(Graph(nodes, ring)).collect()} == {0, 1000, 1001}


@pytest.mark.parametrize("seed", range(2))
def test_reachability_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 60
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(60 + 20 * seed)]
    pairs += [(b, a) for a, b in pairs[:15]]
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)

    def far(start):
        seen, wave = set(start), list(start)
        while wave:
            wave = [b for a in wave for b in ahead.get(a, ()) if b not in seen and not seen.add(b)]
        return seen

    edges = spark.createDataFrame(pairs, "src long, dst long")
    for start in ([0], [1, 2, 999], [pairs[0][0], pairs[-1][0]]):
        got = [r.id for r in reach.reachable(edges, spark.createDataFrame([(i,) for i in start], "id long")).collect()]
        assert len(got) == len(set(got)) and set(got) == far(start)


# Paths over cells


def street_grid(spark, n, seed):
    rng = random.Random(seed)
    at = lambda i, j: i * n + j
    nodes = {at(i, j): (21 + i * 0.001, 105 + j * 0.001) for i in range(n) for j in range(n)}
    rows = []
    for i, j, (di, dj) in itertools.product(range(n), range(n), ((0, 1), (1, 0))):
        if i + di < n and j + dj < n:
            a, b = at(i, j), at(i + di, j + dj)
            rows.append((a, b, rng.choice([112.0, 150.0, 300.0])))
            if rng.random() < 0.8:
                rows.append((b, a, rng.choice([112.0, 120.0])))
    line = lambda a, b: [(nodes[x][1], nodes[x][0]) for x in (a, b)]
    schema = "src long, dst long, way_id long, length double, highway_type string, name string, speed double, c_highway double, geometry array<struct<lon:double,lat:double>>, ord long"
    edges = spark.createDataFrame([(a, b, k, w, "x", "", 36.0, 1.0, line(a, b), k) for k, (a, b, w) in enumerate(rows)], schema)
    return Graph(spark.createDataFrame([(i, *p) for i, p in nodes.items()], "id long, lat double, lon double"), edges), rows


def cheapest(rows, start, goal):
    ahead = {}
    for a, b, w in rows:
        ahead.setdefault(a, []).append((b, w))
    cost, heap, done = {start: 0.0}, [(0.0, start)], set()
    while heap:
        c, u = heapq.heappop(heap)
        if u == goal:
            return c
        if u not in done:
            done.add(u)
            for v, w in ahead.get(u, []):
                if c + w < cost.get(v, 1e300):
                    cost[v] = c + w
                    heapq.heappush(heap, (c + w, v))
    return None


@pytest.mark.parametrize("size, asked", [(10**6, 256), (12, 3)])
def test_paths_over_cells(spark, monkeypatch, size, asked):
    monkeypatch.setattr(cells, "ASKED", asked)
    g, rows = street_grid(spark, 10, 4)
    rng = random.Random(9)
    ask = [(i, rng.randrange(100), rng.randrange(100)) for i in range(20)] + [(50, 0, 10**9), (51, 10**9, 0), (52, 5, 5)]
    requests = spark.createDataFrame(ask, "request_id long, start long, goal long")
    got = {r.request_id: r for r in paths.routes(g, requests, size=size).collect()}
    least = {(a, b): w for a, b, w in rows}
    for i, start, goal in ask:
        want = cheapest(rows, start, goal) if start != goal else None
        assert (want is None) == (i not in got)
        if want is not None:
            path = got[i].path
            assert path[0] == start and path[-1] == goal and got[i].edges == len(path) - 1
            assert abs(sum(least[p] for p in itertools.pairwise(path)) - want) < 1e-6 and abs(got[i].cost - want) < 1e-6
    if size == 12:
        parts = cells.celled(g.nodes, size).groupBy("cell").count().collect()
        assert len(parts) > 5 and max(r["count"] for r in parts) < 40


# Boxes


@pytest.mark.parametrize("load", [20_000, 4])
def test_boxes_of_all_sizes_meet_once(spark, monkeypatch, load):
    monkeypatch.setattr(boxes, "LOAD", load)
    rng = random.Random(load)

    def box(size):
        x, y = rng.uniform(-20, 20), rng.uniform(-20, 20)
        return x, x + rng.random() * size, y, y + rng.random() * size

    small = [(i, *box(rng.choice([0.0, 1e-6, 0.01, 0.5]))) for i in range(150)]
    small += [(200 + i, 7.0 + i / 1000, 7.0 + i / 1000, 7.0, 7.0) for i in range(60)]  # a city in one cell
    large = [(i, *box(rng.choice([1e-4, 0.3, 3.0, 30.0]))) for i in range(40)] + [(50, -180.0, 180.0, -90.0, 90.0), (51, 7.0, 7.01, 7.0, 7.0), (52, 0.0, 8.0, 0.0, 8.0)]
    schema = "{} long, minx double, maxx double, miny double, maxy double"
    met = boxes.meeting(spark.createDataFrame(small, schema.format("i")), spark.createDataFrame(large, schema.format("j")))
    got = [(r.i, r.j) for r in met.select("i", "j").collect()]
    want = {(a[0], b[0]) for a in small for b in large if a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_a_country_is_laid_over_few_cells(spark):
    zone = spark.createDataFrame([(1, 100.0, 112.0, 8.0, 23.0)], "j long, minx double, maxx double, miny double, maxy double")
    roads = spark.range(5000).select("id", *((F.lit(a) + F.col("id") * 1e-6).alias(c) for c, a in (("minx", 105.8), ("maxx", 105.801), ("miny", 21.0), ("maxy", 21.001))))
    assert boxes.meeting(roads, zone).count() == 5000
    at = boxes.level(*(F.col(c) for c in boxes.SIDES))
    assert boxes._cells(zone, F.array(at), "own").count() <= 4
    assert spark.createDataFrame([], "j long, minx double, maxx double, miny double, maxy double").count() == boxes.meeting(roads.limit(0), zone).count() == 0


@pytest.mark.parametrize("points, edges", [(4096, 32768), (3, 5)])
def test_nearest_edges_in_a_dense_place(spark, monkeypatch, points, edges):
    monkeypatch.setattr(spatial, "POINTS", points)
    monkeypatch.setattr(spatial, "EDGES", edges)
    g, rows = street_grid(spark, 6, 3)
    rng = random.Random(1)
    asked = [(i, 21.002 + rng.random() * 1e-4, 105.002 + rng.random() * 1e-4) for i in range(40)] + [(40 + i, 21 + rng.random() * 0.006, 105 + rng.random() * 0.006) for i in range(20)] + [(99, 30.0, 100.0), (98, 21.002, 105.002), (97, 21.002, 105.0025)]
    place = {r.id: (r.lat, r.lon) for r in g.nodes.collect()}

    def plain(lat, lon):
        best = None
        for k, (a, b, _) in enumerate(rows):
            (ay, ax), (by, bx) = place[a], place[b]
            dx, dy = bx - ax, by - ay
            t = max(0.0, min(1.0, ((lon - ax) * dx + (lat - ay) * dy) / (dx * dx + dy * dy)))
            x, y = ax + t * dx, ay + t * dy
            h = math.sin(math.radians(y - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(x - lon) / 2) ** 2
            d = 2 * geo.EARTH_RADIUS * math.atan2(math.sqrt(h), math.sqrt(1 - h))
            if d <= 50 and (best is None or d < best[0]):
                best = (d, k)
        return best

    got = {r.point_id: r for r in spatial.nearest_edges(spark.createDataFrame(asked, "point_id long, lat double, lon double"), g).collect()}
    for i, lat, lon in asked:
        want = plain(lat, lon)
        assert (want is None) == (i not in got)
        if want:
            assert abs(got[i].distance - want[0]) < 1e-6 and {got[i].src, got[i].dst} & set(rows[want[1]][:2])


# House numbers


def test_numbers_of_a_street_with_most_rows(spark):
    rng = random.Random(4)
    rows = [(i, "Long" if i % 3 else rng.choice(["A", "B", "Été"]), str(rng.randrange(0, 4000, 3)) if i % 7 else f"{i}A", rng.random(), rng.random()) for i in range(900)]
    asked = [(i, rng.randrange(-5, 4100), rng.choice(["Long", "Long", "A", "B", "Été", "None"])) for i in range(300)] + [(300, None, "A"), (301, 5, None), (302, 7, "A"), (302, 7, "A")]
    houses = spark.createDataFrame(rows, "id long, street_name string, house_number string, lat double, lon double")
    got = sorted((r.query_id, r.method, round(r.lat, 9), round(r.lon, 9)) for r in geocode.interpolate(houses, spark.createDataFrame(asked, "query_id long, house_number int, street string")).collect())
    known = {}
    for i, street, n, lat, lon in rows:
        if n.isdigit():
            known.setdefault(street, {}).setdefault(int(n), (i, lat, lon))
    want = []
    for q, n, street in asked:
        own = known.get(street)
        if n is None or not own:
            continue
        lo, hi = max((k for k in own if k < n), default=None), min((k for k in own if k > n), default=None)
        if n in own:
            want.append((q, "exact", *own[n][1:]))
        elif lo is not None and hi is not None:
            share = (n - lo) / (hi - lo)
            want.append((q, "interpolated", *(a + share * (b - a) for a, b in zip(own[lo][1:], own[hi][1:], strict=True))))
        else:
            want.append((q, "fallback_lower" if hi is None else "fallback_upper", *own[lo if hi is None else hi][1:]))
    assert got == sorted((q, m, round(a, 9), round(b, 9)) for q, m, a, b in want)


# Lookups


def test_lookups_read_few_files(spark):
    g, rows = street_grid(spark, 6, 5)
    addresses = spark.createDataFrame([(k, k % 20, f"{k} Main") for k in range(50)], "id long, node_id long, address string")
    held = lookup.store(g, addresses)
    assert {r.id for r in lookup.nodes(held, [3, 35, 99]).collect()} == {3, 35}
    ids = spark.createDataFrame([(3,), (3,), (99,), (7,)], "id long")
    assert {(r.id, r.known) for r in lookup.has_nodes(held, ids).collect()} == {(3, True), (7, True), (99, False)}
    near = {r.id: [(n.ord, n.dst) for n in r.neighbours] for r in lookup.neighbours(held, ids).collect()}
    assert near == {i: [(k, b) for k, (a, b, _) in enumerate(rows) if a == i] for i in (3, 7)}
    assert {(r.node_id, r.address) for r in lookup.address_of(held, ids).collect()} == {(3, "3 Main"), (7, "7 Main")}
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells
    try:
        assert "SelectedBucketsCount: 1 out of 4" in lookup.nodes(held, [3])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
