"""Schemas of the tables that operators take and give."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

TAGS = "map<string,string>"
POINT = "struct<lon:double,lat:double>"
LINE = f"array<{POINT}>"

OSM_NODES = f"id long, lat double, lon double, tags {TAGS}"
OSM_WAYS = f"id long, nodes array<long>, tags {TAGS}, ord long"
OSM_ELEMENTS = f"elements array<struct<type:string,id:long,lat:double,lon:double,nodes:array<long>,tags:{TAGS}>>"

NODES = "id long, lat double, lon double"
EDGES = f"src long, dst long, way_id long, length double, highway_type string, name string, speed double, c_highway double, geometry {LINE}, ord long"
OVERLAY = "src long, dst long, blocked boolean, penalty double"

ADDRESSES = "id long, node_id long, lat double, lon double, address string, house_number string, street_name string, address_type string, rank_score double"

#: parts: polygons as lists of rings; lines and points are one part of one ring.
ZONES = f"zone_id long, ord long, geom_type string, parts array<array<{LINE}>>, radius double, block_type string, penalty double, path array<long>"
STORED_ZONES = "id long, name string, type string, geometry string, severity double, is_active boolean, updated_at timestamp"

REQUESTS = "request_id long, origin_kind string, origin_node long, origin_lat double, origin_lon double, origin_address string, dest_kind string, dest_node long, dest_lat double, dest_lon double, dest_address string, weather string"


@dataclass(frozen=True)
class OsmData:
    """Map data: nodes by id and ways in order."""

    nodes: DataFrame
    ways: DataFrame


@dataclass(frozen=True)
class Graph:
    """A directed multigraph: nodes by id, edges in adjacency order (ord)."""

    nodes: DataFrame
    edges: DataFrame
