"""A road network, addresses, zones and requests derived from the benchmark tables, in integer arithmetic, so that any SQL engine derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanemesh.schemas import OsmData

# Road classes by way number; the last four are not roads.
HIGHWAYS = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "residential", "living_street", "unclassified", "service", "footway", "construction", "busway", ""]
SOUTH, WEST = 20.985, 105.855
WAY_NODES = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(key: str, by_lat: int, by_lon: int) -> tuple:
    return (F.lit(SOUTH) + ((F.col(key) * by_lat) % 3001) / 100000.0, F.lit(WEST) + ((F.col(key) * by_lon) % 4001) / 100000.0)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = _place("p_partkey", 7919, 104729)
    return table(spark, d, "part").select((F.col("p_partkey") + 1).alias("id"), lat.alias("lat"), lon.alias("lon"), F.create_map().cast("map<string,string>").alias("tags"))


def ways(spark: SparkSession, d: str) -> DataFrame:
    """Each WAY_NODES events in a row are a way; an event's node is dealt by its user."""
    node = (F.col("user_id") * 31 + F.col("event_id") * 17) % table(spark, d, "part").count() + 1
    order = F.array_sort(F.collect_list(F.struct("event_id", node.alias("node"))))
    out = table(spark, d, "events").groupBy((F.expr(f"event_id div {WAY_NODES}") + 1).alias("id")).agg(F.transform(order, lambda x: x["node"]).alias("nodes"))
    highway = F.element_at(F.array(*map(F.lit, HIGHWAYS)), (F.col("id") % 18 + 1).cast("int"))
    oneway = F.when(F.col("id") % 7 == 1, "yes").when(F.col("id") % 7 == 2, "-1")
    name = F.when(F.col("id") % 5 != 0, F.concat(F.lit("Street "), (F.col("id") % 97).cast("string")))
    tags = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in (("highway", highway), ("oneway", oneway), ("name", name)))), lambda e: e["v"].isNotNull()))
    return out.select("id", "nodes", tags.alias("tags"), F.col("id").alias("ord"))


def osm(spark: SparkSession, d: str) -> OsmData:
    return OsmData(nodes(spark, d), ways(spark, d))


def houses(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = _place("c_custkey", 6131, 15485863)
    number = F.concat((F.col("c_custkey") % 300 + 1).cast("string"), F.when(F.col("c_custkey") % 20 == 0, "A").otherwise(""))
    street = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("Street "), (F.col("c_custkey") % 97).cast("string")))
    return table(spark, d, "customer").select((F.col("c_custkey") + 1000000).alias("id"), lat.alias("lat"), lon.alias("lon"), number.alias("house_number"), street.alias("street"), F.lit(None).cast("string").alias("name"))


def pois(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = _place("s_suppkey", 4241, 32452843)
    name = F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("Street "), (F.col("s_suppkey") % 97).cast("string"))).otherwise(F.col("s_name"))
    none = F.lit(None).cast("string")
    return table(spark, d, "supplier").select((F.col("s_suppkey") + 2000000).alias("id"), lat.alias("lat"), lon.alias("lon"), none.alias("house_number"), none.alias("street"), name.alias("name"))


def zones(spark: SparkSession, d: str) -> DataFrame:
    """zone_id, name, type, lat, lon, radius_m, severity, is_active, block_type, and parts as ZONES has them."""
    n = F.col("n_nationkey").cast("long")
    lat, lon = F.lit(SOUTH) + ((n * 733) % 3001) / 100000.0, F.lit(WEST) + ((n * 1871) % 4001) / 100000.0
    kind = F.element_at(F.array(*map(F.lit, ("polygon", "circle", "multipolygon"))), (n % 3 + 1).cast("int"))
    severity = F.when(n != 7, F.element_at(F.array(*(F.lit(float(x)) for x in (2, 5, 15, 99, 100, 120))), (n % 6 + 1).cast("int")))
    out = table(spark, d, "nation").select(n.alias("zone_id"), F.col("n_name").alias("name"), kind.alias("type"), lat.alias("lat"), lon.alias("lon"), (F.lit(100.0) + (n % 5) * 60).alias("radius_m"), severity.alias("severity"), (n % 5 != 0).alias("is_active"), F.when(n % 8 == 0, "block").otherwise("flood").alias("block_type"))
    p = lambda x, y: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    h = 0.0015
    ring = lambda x: F.array(p(x - h, -h), p(x + h, -h), p(x + h, h), p(x - h, h), p(x - h, -h))
    parts = F.when(F.col("type") == "circle", F.array(F.array(F.array(p(0.0, 0.0))))).when(F.col("type") == "polygon", F.array(F.array(ring(0.0)))).otherwise(F.array(F.array(ring(0.0)), F.array(ring(0.004))))
    return out.withColumn("parts", parts)


def zone_rows(spark: SparkSession, d: str) -> DataFrame:
    """Active zones in the shape of ZONES; the severity is the penalty of flood zones."""
    z = zones(spark, d).where("is_active")
    kind = F.when(F.col("type") == "circle", "Point").when(F.col("type") == "polygon", "Polygon").otherwise("MultiPolygon")
    return z.select("zone_id", F.col("zone_id").alias("ord"), kind.alias("geom_type"), "parts", F.when(F.col("type") == "circle", F.col("radius_m")).alias("radius"), "block_type", F.when(F.col("block_type") == "flood", F.col("severity")).alias("penalty"), F.lit(None).cast("array<long>").alias("path"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The texts of documents as addresses."""
    rank = F.element_at(F.array(F.lit(50.0), F.lit(80.0), F.lit(100.0)), (F.col("doc_id") % 3 + 1).cast("int"))
    null = F.lit(None).cast("string")
    return table(spark, d, "documents").select((F.col("doc_id") + 1).alias("id"), (F.col("doc_id") + 1).alias("node_id"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.col("text").alias("address"), null.alias("house_number"), null.alias("street_name"), F.lit("poi").alias("address_type"), rank.alias("rank_score"))


def corpus_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries for the corpus, of each document whose id 50 divides: its first two words, the second cut to three letters, or its second word."""
    docs = table(spark, d, "documents").where("doc_id % 50 = 0")
    words = F.split("text", r"\s+")
    two = F.concat_ws(" ", F.get(words, F.lit(0)), F.substring(F.get(words, F.lit(1)), 1, 3))
    return docs.select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 100 == 0, two).otherwise(F.get(words, F.lit(1))).alias("query"))


# The same in DuckDB SQL, as common table expressions.

_WAY_NODES = f"fx_way_nodes AS (SELECT event_id // {WAY_NODES} + 1 AS way_id, event_id % {WAY_NODES} AS pos, (user_id * 31 + event_id * 17) % parts + 1 AS node_id FROM events, (SELECT count(*) AS parts FROM part))"
_HIGHWAY_LIST = "[" + ", ".join(f"'{h}'" for h in HIGHWAYS) + "]"
_WAYS = f"fx_ways AS (SELECT DISTINCT way_id, {_HIGHWAY_LIST}[way_id % 18 + 1] AS highway, CASE WHEN way_id % 7 = 1 THEN 'yes' WHEN way_id % 7 = 2 THEN '-1' END AS oneway, CASE WHEN way_id % 5 <> 0 THEN 'Street ' || CAST(way_id % 97 AS VARCHAR) END AS name FROM fx_way_nodes)"
_NODES = "fx_nodes AS (SELECT p_partkey + 1 AS id, 20.985::DOUBLE + ((p_partkey * 7919) % 3001) / 100000.0::DOUBLE AS lat, 105.855::DOUBLE + ((p_partkey * 104729) % 4001) / 100000.0::DOUBLE AS lon FROM part)"


def _dim_sql() -> str:
    from lanemesh.functions.roads import ROAD_CLASSES

    return "dim(highway_type, c_highway, normal, rain, flood, speed, ord) AS (VALUES " + ", ".join(f"('{r[0]}', {', '.join(f'{x}::DOUBLE' for x in r[1:])}, {i})" for i, r in enumerate(ROAD_CLASSES)) + ")"


def hav(a: str, b: str, c: str, d: str) -> str:
    q = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(12742000.0::DOUBLE * atan2(sqrt({q}), sqrt(1 - {q})))"


_SEGMENTS = "seg AS (SELECT w.way_id, n.pos, n.node_id AS a, lead(n.node_id) OVER (PARTITION BY w.way_id ORDER BY n.pos) AS b, w.highway, w.oneway, coalesce(w.name, '') AS name FROM fx_ways w JOIN fx_way_nodes n USING (way_id) WHERE w.highway IN (SELECT highway_type FROM dim))"
_EDGES = f"""dirs AS (
  SELECT way_id, pos, a AS src, b AS dst, highway, name, 0 AS step FROM seg WHERE b IS NOT NULL AND coalesce(oneway, 'no') <> '-1'
  UNION ALL SELECT way_id, pos, b, a, highway, name, 1 FROM seg WHERE b IS NOT NULL AND coalesce(oneway, 'no') <> 'yes'),
fx_edges AS MATERIALIZED (SELECT d.src, d.dst, d.way_id, {hav('s.lat', 's.lon', 't.lat', 't.lon')} AS length, d.highway AS highway_type, d.name, k.speed, k.c_highway, k.normal, k.rain, k.flood,
  s.lat AS src_lat, s.lon AS src_lon, t.lat AS dst_lat, t.lon AS dst_lon, (d.way_id * 1048576 + d.pos) * 2 + d.step AS ord
  FROM dirs d JOIN fx_nodes s ON s.id = d.src JOIN fx_nodes t ON t.id = d.dst JOIN dim k ON k.highway_type = d.highway)"""
_HUB = "hub AS (SELECT src AS id FROM (SELECT src, count(*) AS n FROM fx_edges GROUP BY src) ORDER BY n DESC, src LIMIT 1)"
_LSCC = """fwd(id) AS (SELECT id FROM hub UNION SELECT e.dst FROM fwd f JOIN fx_edges e ON e.src = f.id),
bwd(id) AS (SELECT id FROM hub UNION SELECT e.src FROM bwd f JOIN fx_edges e ON e.dst = f.id),
lscc AS MATERIALIZED (SELECT id FROM fwd INTERSECT SELECT id FROM bwd),
lscc_edges AS MATERIALIZED (SELECT * FROM fx_edges WHERE src IN (SELECT id FROM lscc) AND dst IN (SELECT id FROM lscc))"""
_HOUSES = "fx_houses AS (SELECT c_custkey + 1000000 AS id, 20.985::DOUBLE + ((c_custkey * 6131) % 3001) / 100000.0::DOUBLE AS lat, 105.855::DOUBLE + ((c_custkey * 15485863) % 4001) / 100000.0::DOUBLE AS lon, CAST(c_custkey % 300 + 1 AS VARCHAR) || CASE WHEN c_custkey % 20 = 0 THEN 'A' ELSE '' END AS house_number, CASE WHEN c_nationkey % 2 = 0 THEN 'Street ' || CAST(c_custkey % 97 AS VARCHAR) END AS street FROM customer)"
_POIS = "fx_pois AS (SELECT s_suppkey + 2000000 AS id, 20.985::DOUBLE + ((s_suppkey * 4241) % 3001) / 100000.0::DOUBLE AS lat, 105.855::DOUBLE + ((s_suppkey * 32452843) % 4001) / 100000.0::DOUBLE AS lon, CASE WHEN s_suppkey % 10 = 0 THEN 'Street ' || CAST(s_suppkey % 97 AS VARCHAR) ELSE s_name END AS name FROM supplier)"
_ZONES = "fx_zones AS (SELECT n AS zone_id, name, ['polygon', 'circle', 'multipolygon'][n % 3 + 1] AS type, 20.985::DOUBLE + ((n * 733) % 3001) / 100000.0::DOUBLE AS lat, 105.855::DOUBLE + ((n * 1871) % 4001) / 100000.0::DOUBLE AS lon, 100.0::DOUBLE + (n % 5) * 60 AS radius_m, CASE WHEN n <> 7 THEN [2, 5, 15, 99, 100, 120][n % 6 + 1]::DOUBLE END AS severity, n % 5 <> 0 AS is_active, CASE WHEN n % 8 = 0 THEN 'block' ELSE 'flood' END AS block_type FROM (SELECT CAST(n_nationkey AS BIGINT) AS n, n_name AS name FROM nation))"
_STREETS = """named AS (SELECT w.way_id, w.name, n.pos, n.node_id, x.lat, x.lon FROM fx_ways w JOIN fx_way_nodes n USING (way_id) JOIN fx_nodes x ON x.id = n.node_id WHERE w.highway IN (SELECT highway_type FROM dim) AND w.name IS NOT NULL),
centroids AS (SELECT way_id AS id, name, avg(lat) AS lat, avg(lon) AS lon FROM named GROUP BY way_id, name)"""

ROADS = [_WAY_NODES, _WAYS, _NODES, _dim_sql(), _SEGMENTS, _EDGES]
COMPONENT = [*ROADS, _HUB, _LSCC]
HOUSES, POIS, ZONES, STREETS = _HOUSES, _POIS, _ZONES, _STREETS


def sql(parts: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select
