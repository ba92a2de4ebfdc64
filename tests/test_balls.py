import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lanemesh.operators import balls, cells, paths
from lanemesh.schemas import Graph

SCHEMA = "src long, dst long, way_id long, length double, highway_type string, name string, speed double, c_highway double, geometry array<struct<lon:double,lat:double>>, ord long"


def anywhere(spark, n, degree, whole=False):
    """A graph whose edges lead anywhere, some of them parallel; whole lengths make ties."""
    rng = random.Random(n)
    at = {i: (rng.random() / 100, rng.random() / 100) for i in range(n)}
    rows = []
    for k in range(n * degree):
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b:
            length = float(2000 + rng.randrange(3) * 500) if whole else 2000 + 1000 * rng.random()
            rows += [(a, b, k, length, "secondary", "", 50.0, 1.0, [(at[i][1], at[i][0]) for i in (a, b)], 2 * k), *([(a, b, k, length + 1, "secondary", "", 50.0, 1.0, [(at[i][1], at[i][0]) for i in (a, b)], 2 * k + 1)] if k % 9 == 0 else [])]
    nodes = spark.createDataFrame([(i, *p) for i, p in at.items()], "id long, lat double, lon double")
    least = {}
    for r in rows:
        least[r[0], r[1]] = min(r[3], least.get((r[0], r[1]), 1e300))
    return Graph(nodes, spark.createDataFrame(rows, SCHEMA)), least


def costs(least, start):
    ahead = {}
    for (a, b), w in least.items():
        ahead.setdefault(a, []).append((b, w))
    cost, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        c, u = heapq.heappop(heap)
        if c == cost[u]:
            for v, w in ahead.get(u, []):
                if c + w < cost.get(v, 1e300):
                    cost[v] = c + w
                    heapq.heappush(heap, (c + w, v))
    return cost


@pytest.mark.parametrize("whole", [False, True])
def test_paths_by_balls(spark, monkeypatch, whole):
    monkeypatch.setattr(balls, "FIRST", 16)
    g, least = anywhere(spark, 300, 3, whole)
    rng = random.Random(5)
    ask = [(i, rng.randrange(300), rng.randrange(300)) for i in range(8)] + [(50, 0, 10**9), (51, 10**9, 0), (52, 5, 5)]
    requests = spark.createDataFrame(ask, "request_id long, start long, goal long")
    _, rows = cells.placed(g.nodes, paths.weighted(g.edges).select("src", "dst", "weight", "ord"), 30)
    assert cells.scattered(rows)
    got = {r.request_id: r for r in paths.routes(g, requests, size=30).collect()}
    alone = {r.request_id: r.cost for r in paths.route_costs(g, requests, size=30).collect()}
    assert set(alone) == set(got) and len(got) > 4
    for i, start, goal in ask:
        far = costs(least, start)
        want = far.get(goal) if start != goal else None
        assert (want is None) == (i not in got)
        if want is not None:
            path = got[i].path
            assert path[0] == start and path[-1] == goal and got[i].edges == len(path) - 1
            assert got[i].cost == want and abs(alone[i] - want) < 1e-6
            # of the nodes that give the next its cost, the least
            for a, b in itertools.pairwise(path):
                assert a == min(x for (x, y), w in least.items() if y == b and x in far and far[x] < far[b] and far[x] + w == far[b])


def test_balls_leave_most_of_a_scattered_graph_alone(spark):
    g, _ = anywhere(spark, 20_000, 3)
    edges = paths.weighted(g.edges).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    state = balls.grown(edges, spark.createDataFrame([(1, 1, 2)], "request_id long, start long, goal long"))
    assert state.where("done is not null").count() < 4000 and balls.best(state).first().best is not None
