"""Map data: the query text for a remote server, landed JSON, cached tables, and pushed-down filters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanemesh.functions.roads import ALLOWED, is_oneway, is_reverse_oneway, tag, valid_highway
from lanemesh.schemas import OSM_ELEMENTS, OSM_NODES, OSM_WAYS, OsmData

PLACE_KEYS = ("amenity", "shop", "tourism", "building")
BBox = tuple[float, float, float, float]


def overpass_query(bbox: BBox, highway_types: Iterable[str] | None = None, include_addresses: bool = True) -> str:
    """Overpass QL for the ways of some classes that touch a box (min lat, min lon, max lat, max lon), their nodes, and address nodes."""
    kinds, box = "|".join(highway_types or ALLOWED), ",".join(map(str, bbox))
    parts = [f'way["highway"~"^({kinds})$"]({box});']
    if include_addresses:
        parts.append(f'node["addr:housenumber"]({box});')
        parts += [f'node["name"]["{k}"]({box});' for k in PLACE_KEYS]
    return f"[out:json][timeout:{90 if include_addresses else 60}];\n(\n  " + "\n  ".join(parts) + "\n);\nout body;\n>;\nout skel qt;"


def area_query(name: str) -> str:
    """Overpass QL for the roads of an area by name."""
    quoted = name.replace("\\", "\\\\").replace('"', '\\"')
    return f'[out:json][timeout:60];\narea["name"="{quoted}"]->.a;\nway["highway"~"^({"|".join(ALLOWED)})$"](area.a);\nout body;\n>;\nout skel qt;'


def cache_key(bbox: BBox) -> str:
    return hashlib.sha1(",".join(f"{x:.6f}" for x in bbox).encode()).hexdigest()


def area_cache_key(name: str) -> str:
    return hashlib.sha1(name.encode()).hexdigest()


def cache_key_column(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    return F.sha1(F.format_string("%.6f,%.6f,%.6f,%.6f", min_lat, min_lon, max_lat, max_lon).cast("binary"))


def highway_matches(kinds: Iterable[str] = ALLOWED) -> Column:
    return tag("highway").isin(*kinds)


def in_box(bbox: BBox) -> Column:
    return F.col("lat").between(bbox[0], bbox[2]) & F.col("lon").between(bbox[1], bbox[3])


def is_address_node() -> Column:
    has = lambda k: F.coalesce(F.map_contains_key("tags", k), F.lit(False))
    places = has(PLACE_KEYS[0])
    for k in PLACE_KEYS[1:]:
        places = places | has(k)
    return has("addr:housenumber") | (has("name") & places)


def parse_elements(elements: DataFrame) -> OsmData:
    """Nodes and ways of a stream of elements: columns pos (order), type, id, lat, lon, nodes, tags. Of nodes with one id the last wins; ways keep their order; other types go."""
    no_tags = F.create_map().cast("map<string,string>")
    last = F.max_by(F.struct("lat", "lon", F.coalesce("tags", no_tags).alias("tags")), "pos")
    nodes = elements.where("type = 'node'").groupBy("id").agg(last.alias("n")).select("id", "n.lat", "n.lon", "n.tags")
    ways = elements.where("type = 'way'").select("id", F.coalesce("nodes", F.array().cast("array<bigint>")).alias("nodes"), F.coalesce("tags", no_tags).alias("tags"), F.col("pos").cast("long").alias("ord"))
    return OsmData(nodes, ways)


def read_json(spark: SparkSession, path: str) -> OsmData:
    """Landed server answers: documents with an array `elements`."""
    raw = spark.read.schema(OSM_ELEMENTS).json(path, multiLine=True)
    return parse_elements(raw.select(F.posexplode("elements").alias("pos", "e")).select("pos", "e.*"))


def write_tables(data: OsmData, path: str) -> None:
    data.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    data.ways.write.mode("overwrite").parquet(f"{path}/ways")


def read_tables(spark: SparkSession, path: str) -> OsmData:
    return OsmData(spark.read.schema(OSM_NODES).parquet(f"{path}/nodes"), spark.read.schema(OSM_WAYS).parquet(f"{path}/ways"))


def select_box(data: OsmData, bbox: BBox, kinds: Iterable[str] = ALLOWED, include_addresses: bool = True) -> OsmData:
    """What overpass_query asks a server for, from stored tables: ways of the kinds with a node in the box, all their nodes, and address nodes in it."""
    ways = data.ways.where(highway_matches(kinds))
    inside = data.nodes.where(in_box(bbox))
    used = ways.select(F.col("id").alias("way"), F.explode("nodes").alias("id"))
    touched = used.join(inside.select("id"), "id", "left_semi").select("way").distinct()
    ways = ways.join(touched, ways["id"] == touched["way"], "left_semi")
    wanted = ways.select(F.explode("nodes").alias("id"))
    if include_addresses:
        wanted = wanted.union(inside.where(is_address_node()).select("id"))
    return OsmData(data.nodes.join(wanted.distinct(), "id", "left_semi"), ways)


def fetch(spark: SparkSession, bbox: BBox, cache_dir: str, endpoints: Iterable[Callable[[str], str | None]] = (), use_cache: bool = True) -> OsmData | None:
    """Cached tables of the box, else those of the first endpoint that answers. An endpoint takes a query and lands its answer as JSON, returning the path, or None. A cache that can't be read is a miss; None if nobody answers."""
    return _fetch(spark, f"{cache_dir}/{cache_key(bbox)}", overpass_query(bbox), endpoints, use_cache)


def fetch_area(spark: SparkSession, name: str, cache_dir: str, endpoints: Iterable[Callable[[str], str | None]] = (), use_cache: bool = True) -> OsmData | None:
    return _fetch(spark, f"{cache_dir}/{area_cache_key(name)}", area_query(name), endpoints, use_cache)


def _fetch(spark, path, query, endpoints, use_cache):
    if use_cache:
        try:
            data = read_tables(spark, path)
            data.nodes.limit(1).collect(), data.ways.limit(1).collect()
            return data
        except Exception:
            pass
    for ask in endpoints:
        landed = ask(query)
        if landed is not None:
            data = read_json(spark, landed)
            try:
                write_tables(data, path)
            except Exception:
                return data
            return read_tables(spark, path)
    return None


def valid_ways(ways: DataFrame) -> DataFrame:
    return ways.where(valid_highway(tag("highway")))


def with_direction(ways: DataFrame) -> DataFrame:
    return ways.withColumns({"oneway": is_oneway(), "reverse": is_reverse_oneway()})


def used_nodes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that ways refer to and that exist."""
    return nodes.join(ways.select(F.explode("nodes").alias("id")).distinct(), "id", "left_semi")


def way_nodes(ways: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """way_id, ord, pos, node_id and the columns `keep` of each vertex."""
    return ways.select(F.col("id").alias("way_id"), "ord", *keep, F.posexplode("nodes").alias("pos", "node_id"))
