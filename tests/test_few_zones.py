"""Boxes that meet few zones: sent as cells, and the same pairs as by dealing."""

import random

import pytest
from pyspark.sql import functions as F

from lanemesh.functions import geo
from lanemesh.operators import boxes, spatial

BOX = "{} long, minx double, maxx double, miny double, maxy double"


def some(rng, n, most):
    out = []
    for i in range(n):
        x, y, w, h = rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(0, most), rng.uniform(0, most)
        out.append((i, x, x + w, y, y + h))
    return out


@pytest.mark.parametrize("load", [20_000, 3])
def test_pairs_of_boxes_whether_sent_or_dealt(spark, monkeypatch, load):
    monkeypatch.setattr(boxes, "LOAD", load)
    rng = random.Random(5)
    rows, zones = some(rng, 200, 0.3) + [(200, -2.0, 2.0, -2.0, 2.0)], some(rng, 12, 0.2) + [(12, -1.0, 1.5, -1.0, 1.5)]
    met = boxes.meeting(spark.createDataFrame(rows, BOX.format("i")), spark.createDataFrame(zones, BOX.format("j")))
    want = sorted((a[0], b[0]) for a in rows for b in zones if a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4])
    assert sorted((r.i, r.j) for r in met.collect()) == want
    assert set(met.columns) == {"i", "j", *boxes.SIDES, *(f"z{c}" for c in boxes.SIDES)}


def test_rows_are_not_shuffled_to_few_zones(spark):
    rows = spark.range(1000).select(F.col("id").alias("i"), *((F.col("id") / 1000).alias(c) for c in boxes.SIDES))
    met = boxes.meeting(rows, spark.createDataFrame([(1, 0.1, 0.2, 0.1, 0.2)], BOX.format("j")))
    assert met.count() == 101
    assert "hashpartitioning" not in met._jdf.queryExecution().executedPlan().toString()


def test_overlay_pairs_reads_the_network_once(spark):
    """Pairs each way once, with what the network's own directions and a path say together."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    at = {1: (0.0, 0.0), 2: (0.01, 0.0), 3: (0.02, 0.0), 4: (0.02, 0.01)}
    line = lambda a, b: [dict(zip(("lon", "lat"), at[n], strict=True)) for n in (a, b)]
    rows = [(a, b, i, line(a, b)) for i, (a, b) in enumerate([(1, 2), (2, 1), (2, 3), (3, 4), (3, 3)])]
    kind = "src long, dst long, ord long, geometry array<struct<lon:double,lat:double>>"
    edges = spark.createDataFrame(rows, kind).mapInArrow(counted, kind)
    square = F.array(*(geo.point(F.lit(x), F.lit(y)) for x, y in ((0.019, -0.001), (0.021, -0.001), (0.021, 0.001), (0.019, 0.001), (0.019, -0.001))))
    zone = spark.range(1).select(F.lit(1).cast("long").alias("zone_id"), F.lit(1).cast("long").alias("ord"), F.lit("Polygon").alias("geom_type"), F.array(F.array(square)).alias("parts"), F.lit(None).cast("double").alias("radius"), F.lit("flood").alias("block_type"), F.lit(7.0).alias("penalty"), F.lit(None).cast("array<long>").alias("path"))
    road = zone.select(F.lit(2).cast("long").alias("zone_id"), "ord", F.lit("LineString").alias("geom_type"), F.lit(None).cast(zone.schema["parts"].dataType).alias("parts"), "radius", F.lit("block").alias("block_type"), F.lit(None).cast("double").alias("penalty"), F.array(*map(F.lit, (4, 3, 1))).cast("array<long>").alias("path"))
    got = {(r.src, r.dst, r.blocked, r.penalty) for r in spatial.overlay_pairs(edges, zone.union(road)).collect()}
    assert got == {(2, 3, False, 7.0), (3, 2, False, 7.0), (3, 3, False, 7.0), (3, 4, True, 7.0), (4, 3, True, 7.0)}
    assert seen.value == len(rows)
