"""Nearest sites against every pair, where they are evenly spread, crowded, around the poles and over the date line."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanemesh.operators import nearest, spatial

SITES, POINTS = "id long, lat double, lon double", "point_id long, lat double, lon double"


def metres(a, b):
    (lat1, lon1), (lat2, lon2) = ([math.radians(v) for v in p] for p in (a, b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def every_pair(points, sites, distance, within=math.inf):
    out = {}
    for key, *at in points:
        d, i = min((distance(at, to), i) for i, *to in sites)
        if d <= within:
            out[key] = (i, d)
    return out


def city(rng, n, spread=0.01):
    return [(21.0 + rng.gauss(0, spread), 105.8 + rng.gauss(0, spread)) for _ in range(n)]


def world(rng, n):
    return [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(n)]


@pytest.fixture
def small(monkeypatch):
    """Many cells, dealt points and dealt sites on few rows."""
    for name, value in (("IN_CELL", 60), ("CELLS", 16), ("POINTS", 40), ("SITES", 50), ("FAN", 4), ("AT_ONCE", 16)):
        monkeypatch.setattr(nearest, name, value)


@pytest.mark.parametrize("metric", ["planar", "haversine"])
def test_against_every_pair(spark, small, metric):
    rng = random.Random(metric)
    at = city(rng, 300) + world(rng, 200) + [(21.0, 105.8)] * 150 + [(90.0, 10.0), (-89.99, 0.0), (0.0, 179.999), (0.0, -179.9)]
    ids = rng.sample(range(10_000), len(at))
    sites = [(i, *p) for i, p in zip(ids, at, strict=True)]
    asked = city(rng, 60) + world(rng, 60) + [(0.0, -179.9999), (89.9, -170.0), (-90.0, 77.0), (21.0, 105.8), at[3]]
    points = list(enumerate(asked))
    points = [(k, *p) for k, p in points]
    got = spatial.nearest_nodes(spark.createDataFrame(points, POINTS), spark.createDataFrame(sites, SITES), metric=metric).collect()
    want = every_pair(points, sites, metres if metric == "haversine" else lambda a, b: math.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1])))
    assert {r.point_id: r.node_id for r in got} == {k: v[0] for k, v in want.items()}
    assert all(abs(r.distance - want[r.point_id][1]) <= 1e-6 for r in got)


def test_within_a_cutoff_against_every_pair(spark, small):
    rng = random.Random(9)
    sites = [(i, *p) for i, p in enumerate(city(rng, 400) + world(rng, 50))]
    points = [(k, *p) for k, p in enumerate(city(rng, 80) + world(rng, 30))]
    got = spatial.snap(spark.createDataFrame(points, POINTS), spark.createDataFrame(sites, SITES), 100.0).collect()
    want = {k: i for k, (i, d) in every_pair(points, sites, metres).items() if d < 100}
    assert 0 < len(want) < len(points) and {r.point_id: r.node_id for r in got} == want


def test_rows_without_coordinates_and_empty_tables(spark):
    sites = spark.createDataFrame([(1, None, 2.0), (2, 5.0, float("nan")), (3, 7.0, 7.0)], SITES)
    points = spark.createDataFrame([(0, None, 1.0), (1, 1.0, 1.0), (2, float("nan"), 0.0)], POINTS)
    assert [(r.point_id, r.node_id) for r in spatial.nearest_nodes(points, sites).collect()] == [(1, 3)]
    for p, s in ((points, sites.limit(0)), (points.limit(0), sites), (points, sites.where("id < 3"))):
        assert spatial.nearest_nodes(p, s, metric="haversine").collect() == []


def test_a_crowded_place_makes_no_hot_task(spark, monkeypatch):
    """Half of the sites lie in a thousandth of a degree: cells still hold about as many each, and each task few of them."""
    monkeypatch.setattr(nearest, "IN_CELL", 500)
    sites = spark.range(8000).select("id", *(F.when(F.col("id") % 2 == 0, F.rand(s) * 0.001).otherwise(F.rand(s + 9) * 50).alias(c) for s, c in enumerate(("lat", "lon"))))
    x = nearest.places(*(np.array(v) for v in zip(*[(r.lat, r.lon) for r in sites.collect()], strict=True)), "planar")
    sizes = np.bincount(nearest.Splits(x[::3], 4).cells(x), minlength=16)
    assert sizes.max() < 2 * sizes.mean() and sizes.min() > 0
    points = spark.createDataFrame([(0, 0.0005, 0.0005), (1, 25.0, 25.0)], POINTS)
    best = {r.point_id: r.node_id for r in spatial.nearest_nodes(points, sites).collect()}
    assert best == {k: int(((x - p) ** 2).sum(axis=1).argmin()) for k, p in enumerate(([0.0005, 0.0005], [25.0, 25.0]))}


def test_a_search_looks_at_few_sites(monkeypatch):
    rng = np.random.default_rng(3)
    tree, looked = nearest.Boxes(rng.random((32_768, 2))), []
    inside = tree._inside
    monkeypatch.setattr(tree, "_inside", lambda boxes, level: (lambda r: (looked.append(len(r[0]) if level == 0 else 0), r)[1])(inside(boxes, level)))
    points = rng.random((256, 2))
    who, what, far = tree.near(points, np.full(256, np.inf))
    assert len(who) == 256 and sum(looked) / 256 < 200
