"""Nearest edges in dense cells: boxes of points rule edges out, and lose none."""

import math

import numpy as np
import pyarrow as pa
import pytest

from lanemesh.operators import spatial
from lanemesh.schemas import Graph


@pytest.mark.parametrize(("latitude", "same"), [(21.0, False), (70.0, False), (-89.9, False), (0.0, True)])
def test_dense_cells_compare_few_pairs(latitude, same):
    rng = np.random.default_rng(7)
    n, m = 1500, 6000
    metres = 50.0
    dlat = metres / spatial.METRES_A_RADIAN_DEGREE * 1.001
    dlon = dlat / max(math.cos(math.radians(min(89.0, abs(latitude) + 0.02))), 1e-3)
    side = lambda k, of, w: of + rng.uniform(-w, w, k)
    lat, lon = side(n, latitude, 2 * dlat), side(n, 105.0, 2 * dlon)
    if same:
        lat[:], lon[:] = lat[0], lon[0]
    ends = [side(m, 105.0, 6 * dlon), side(m, latitude, 6 * dlat), side(m, 105.0, 6 * dlon), side(m, latitude, 6 * dlat)]
    for k in (0, 2):
        ends[k][:50] = ends[0][:50]
        ends[k + 1][:50] = ends[1][:50]
    points = pa.table({"key_": np.arange(n), "plat": lat, "plon": lon})
    edges = pa.table({"src_lon": ends[0], "src_lat": ends[1], "dst_lon": ends[2], "dst_lat": ends[3], "ord": np.arange(m)})
    pairs = sum(len(own) * len(seen) for own, seen in spatial._blocks(lon, lat, tuple(ends), dlat))
    if abs(latitude) < 60 and not same:
        assert pairs < n * m / 6
    want = set()
    for k in range(n):
        x, y = spatial._projected(lon[k], lat[k], *ends)
        y1, y2, x1, x2 = (np.radians(v) for v in (lat[k], y, lon[k], x))
        a = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
        far = 2 * spatial.geo.EARTH_RADIUS * np.arctan2(np.sqrt(a), np.sqrt(1 - a))
        if far.min() <= metres:
            want.add((k, int(far.argmin())))
    got = spatial._nearest_rows(points, edges, dlat, dlon)
    assert want and want <= set(zip(got["key_"].to_pylist(), got["ord"].to_pylist(), strict=True))


def test_long_edges_cross_few_cells(spark, monkeypatch):
    """Cells grow while they have few points, and an edge is laid out once for both its directions."""
    rng = np.random.default_rng(11)
    at = {i: (21 + float(y), 105 + float(x)) for i, (y, x) in enumerate(rng.uniform(0, 0.03, (60, 2)))}
    pairs = [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(400)]
    edges = [(a, b, 2 * k) for k, (a, b) in enumerate(pairs)] + [(b, a, 2 * k + 1) for k, (a, b) in enumerate(pairs)]
    asked = [(i, *(at[i] if i < 20 else (21 + float(rng.uniform(0, 0.03)), 105 + float(rng.uniform(0, 0.03))))) for i in range(120)]
    g = Graph(spark.createDataFrame([(i, *p) for i, p in at.items()], "id long, lat double, lon double"), spark.createDataFrame(edges, "src long, dst long, ord long"))
    points = spark.createDataFrame(asked, "point_id long, lat double, lon double")
    seen, laid_out = [], spatial._laid_out

    def counted(*parts):
        left, right = laid_out(*parts)
        seen.append((left.count(), right.count(), left.select("at").distinct().count()))
        return left, right

    monkeypatch.setattr(spatial, "_laid_out", counted)

    def plain(lat, lon):
        best = (50.0 + 1e-9, 0)
        for a, b, k in edges:
            (ay, ax), (by, bx) = at[a], at[b]
            size = (bx - ax) ** 2 + (by - ay) ** 2
            t = max(0.0, min(1.0, ((lon - ax) * (bx - ax) + (lat - ay) * (by - ay)) / size)) if size else 0.0
            x, y = ax + t * (bx - ax), ay + t * (by - ay)
            h = math.sin(math.radians(y - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(x - lon) / 2) ** 2
            best = min(best, (2 * spatial.geo.EARTH_RADIUS * math.atan2(math.sqrt(h), math.sqrt(1 - h)), k))
        return best

    for most, dealt in ((4096, 8192), (30, 50)):
        monkeypatch.setattr(spatial, "POINTS", most)
        monkeypatch.setattr(spatial, "EDGES", dealt)
        got = {r.point_id: r.distance for r in spatial.nearest_edges(points, g).collect()}
        want = {i: plain(lat, lon)[0] for i, lat, lon in asked}
        assert got == {i: pytest.approx(d, abs=1e-6) for i, d in want.items() if d <= 50}
    assert [s[0] for s in seen] == [120, 120] and seen[0][1] <= 4 * 400 and seen[1][2] > 1


def test_virtual_nodes_where_directions_tie(spark, monkeypatch):
    """Edges between two nodes are compared once, and of all of them, whatever the direction, the least ord is taken among the nearest."""
    nodes = spark.createDataFrame([(1, 21.0, 105.0), (2, 21.0, 105.01), (3, 21.001, 105.0)], "id long, lat double, lon double")
    edges = [(1, 2, 7), (2, 1, 4), (1, 2, 5), (3, 3, 1), (1, 3, 9), (3, 1, 8)]
    points = spark.createDataFrame([(0, 21.0, 105.0), (1, 21.0, 105.01), (2, 21.0001, 105.0), (3, 21.001, 105.0), (4, 21.1, 105.0)], "point_id long, lat double, lon double")
    rows, laid_out = [], spatial._laid_out

    def counted(here, segments, *more):
        rows.append(segments.count())
        return laid_out(here, segments, *more)

    monkeypatch.setattr(spatial, "_laid_out", counted)
    g = Graph(nodes, spark.createDataFrame(edges, "src long, dst long, ord long"))
    got = {r.point_id: [n.id for n in r.neighbours] for r in spatial.virtual_nodes(points, g).collect()}
    assert got == {0: [2, 1], 1: [2, 1], 2: [3, 1], 3: [3, 3]} and rows == [3]


@pytest.mark.parametrize("latitude", [0.0, 89.9995])
def test_a_point_on_an_edge_far_north(latitude):
    points = pa.table({"key_": [1], "plat": [latitude], "plon": [105.0]})
    edges = pa.table({"src_lon": [105.0, 105.1], "src_lat": [latitude, latitude], "dst_lon": [105.01, 105.1], "dst_lat": [latitude, latitude - 1e-4], "ord": [3, 4]})
    got = spatial._nearest_rows(points, edges, 4.5e-4, 0.5)
    assert got.to_pylist() == [{"key_": 1, "ord": 3, "far": 0.0}]
