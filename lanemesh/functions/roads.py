"""Road classes: coefficients, speeds and the columns that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class, base coefficient, and its factors in normal, rain and flood, speed in km/h.
ROAD_CLASSES = [
    ("motorway", 0.70, 1.0, 1.10, 1.2, 100.0),
    ("motorway_link", 0.75, 1.0, 1.15, 1.3, 60.0),
    ("trunk", 0.75, 1.0, 1.15, 1.3, 80.0),
    ("trunk_link", 0.80, 1.0, 1.20, 1.4, 50.0),
    ("primary", 0.80, 1.0, 1.20, 1.4, 60.0),
    ("primary_link", 0.85, 1.0, 1.25, 1.5, 40.0),
    ("secondary", 1.00, 1.0, 1.50, 2.0, 50.0),
    ("secondary_link", 1.05, 1.0, 1.60, 2.2, 35.0),
    ("tertiary", 1.10, 1.0, 2.00, 3.0, 40.0),
    ("tertiary_link", 1.15, 1.0, 2.10, 3.5, 30.0),
    ("residential", 1.20, 1.0, 2.50, 4.5, 30.0),
    ("living_street", 1.30, 1.0, 3.00, 6.0, 20.0),
    ("unclassified", 1.20, 1.0, 2.00, 4.0, 30.0),
    ("service", 1.50, 1.0, 3.50, 7.0, 20.0),
]
WEATHERS = ("normal", "rain", "flood")
ALLOWED = tuple(r[0] for r in ROAD_CLASSES)
DEFAULT_SPEED, DEFAULT_COEFFICIENT = 30.0, 1.0


def _lookup(at: int, key: Column, default: float) -> Column:
    pairs = [x for r in ROAD_CLASSES for x in (F.lit(r[0]), F.lit(r[at]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def base_coefficient(kind: Column) -> Column:
    return _lookup(1, kind, DEFAULT_COEFFICIENT)


def speed(kind: Column) -> Column:
    """km/h; 30 for unknown classes."""
    return _lookup(5, kind, DEFAULT_SPEED)


def weather_factor(kind: Column, weather: Column | str) -> Column:
    """1.0 for unknown classes; an unknown or null weather counts as normal."""
    weather = F.lit(weather) if isinstance(weather, str) else weather
    return F.when(weather == "rain", _lookup(3, kind, 1.0)).when(weather == "flood", _lookup(4, kind, 1.0)).otherwise(_lookup(2, kind, 1.0))


def weight(weather: Column | str = "normal") -> Column:
    """An edge's cost: length times base coefficient times weather factor."""
    return F.col("length") * F.col("c_highway") * weather_factor(F.col("highway_type"), weather)


def travel_time() -> Column:
    """Seconds along an edge."""
    return F.col("length") / 1000 / F.col("speed") * 3600


def coefficients(spark: SparkSession, weather: str = "normal") -> DataFrame:
    """highway_type, c_highway, c_context, total of each class, least total first, then in the classes' order."""
    at = 2 + (WEATHERS.index(weather) if weather in WEATHERS else 0)
    rows = [(r[0], r[1], r[at], i) for i, r in enumerate(ROAD_CLASSES)]
    df = spark.createDataFrame(rows, "highway_type string, c_highway double, c_context double, ord int")
    return df.withColumn("total", F.round(F.col("c_highway") * F.col("c_context"), 3)).orderBy("total", "ord").drop("ord")


def valid_highway(kind: Column) -> Column:
    return kind.isNotNull() & kind.isin(*ALLOWED)


def tag(name: str) -> Column:
    return F.try_element_at(F.col("tags"), F.lit(name))


def is_oneway() -> Column:
    return F.coalesce(tag("oneway"), F.lit("no")).isin("yes", "1", "true", "-1")


def is_reverse_oneway() -> Column:
    return F.coalesce(tag("oneway"), F.lit("no")) == "-1"
