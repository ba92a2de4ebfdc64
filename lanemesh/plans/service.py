"""The engine: a built graph and its addresses, and the batch forms of the service's requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanemesh.functions.roads import WEATHERS, coefficients
from lanemesh.lineage import cut
from lanemesh.operators import geocode, graph, paths, postings, spatial
from lanemesh.schemas import Graph, OsmData


def validated(requests: DataFrame) -> DataFrame:
    """requests with weather made one of the known ones for use, and error, null if the request is sound."""

    def problem(side: str):
        kind = F.col(f"{side}_kind")
        lat, lon, address = F.col(f"{side}_lat"), F.col(f"{side}_lon"), F.col(f"{side}_address")
        coords = F.when(lat.isNull() | lon.isNull(), f"{side}: coordinates must be two numbers").when(~lat.between(-90, 90), f"{side}: latitude out of range").when(~lon.between(-180, 180), f"{side}: longitude out of range")
        return (
            F.when(kind == "address", F.when(F.coalesce(F.length(F.trim(address)), F.lit(0)) < 2, f"{side}: address too short"))
            .when(kind == "coords", coords)
            .when(kind == "node", F.when(F.col(f"{side}_node").isNull(), f"{side}: node id missing"))
            .otherwise(F.lit(f"{side}: unknown kind"))
        )

    weather = F.coalesce("weather", F.lit("normal"))
    return requests.withColumns({"error": F.coalesce(problem("origin"), problem("dest"), F.when(~weather.isin(*WEATHERS), "unknown weather")), "weather": F.when(weather.isin(*WEATHERS), weather).otherwise("normal")})


@dataclass
class Engine:
    """Holds what requests are answered from."""

    spark: SparkSession
    graph: Graph
    index: postings.Index

    @classmethod
    def load(cls, spark: SparkSession, data: OsmData) -> Engine:
        built = graph.build_graph(data)
        return cls(spark, built, postings.build(cut(geocode.extract_addresses(data, built))))

    def health(self) -> DataFrame:
        """status, node_count, edge_count and bounds."""
        return graph.statistics(self.graph).select(F.when(F.col("node_count") > 0, "ok").otherwise("not_ready").alias("status"), "*")

    def info(self) -> DataFrame:
        """health, with the number of addresses."""
        n = self.index.rows
        return self.health().withColumns({"addresses": F.lit(n), "weathers": F.lit(",".join(WEATHERS))})

    def geocoding_stats(self) -> DataFrame:
        return geocode.address_stats(self.index.addresses)

    def coefficients(self, weather: str = "normal") -> DataFrame:
        return coefficients(self.spark, weather)

    def nearest_nodes(self, points: DataFrame) -> DataFrame:
        return spatial.nearest_nodes(points, self.graph.nodes)

    def suggest(self, queries: DataFrame, limit: int = 5) -> DataFrame:
        """Searches for batches of queries; the limit goes from 1 to 20."""
        if not 1 <= limit <= 20:
            raise ValueError("limit must be from 1 to 20")
        return geocode.search(self.index, queries, limit)

    def resolve(self, points: DataFrame) -> DataFrame:
        return geocode.resolve(points, self.graph, self.index)

    def overlay(self, blocking: DataFrame | None, flood: DataFrame | None, block_intersections: bool = True) -> tuple[DataFrame, DataFrame] | None:
        """The overlay of GeoJSON features (column feature): blocking ones, then flood ones, whose type is forced."""
        lists = [(x, kind) for x, kind in ((blocking, None), (flood, "flood")) if x is not None]
        if not lists:
            return None
        every = None
        for x, kind in lists:
            rows = x.select(F.xxhash64("feature", F.lit(kind or "")).alias("zone_id"), "feature", F.lit(kind).cast("string").alias("forced_type"))
            every = rows if every is None else every.union(rows)
        zones = cut(spatial.parse_zones(every.withColumn("ord", F.col("zone_id"))))
        pairs, nodes = spatial.overlay(self.graph, zones, block_intersections)
        return cut(pairs), cut(nodes)

    def route(self, requests: DataFrame, blocking: DataFrame | None = None, flood: DataFrame | None = None) -> DataFrame:
        """request_id, error, resolved end points, path, distance (m), minutes, route (GeoJSON), affected_edges of a batch of requests; those that fail keep a row with their error."""
        asked = cut(validated(requests))
        side = lambda s: asked.where("error is null").select(F.concat_ws(":", "request_id", F.lit(s)).alias("point_id"), F.col(f"{s}_kind").alias("kind"), F.col(f"{s}_node").alias("node"), F.col(f"{s}_lat").alias("lat"), F.col(f"{s}_lon").alias("lon"), F.col(f"{s}_address").alias("address"))
        ends = cut(self.resolve(side("origin").union(side("dest"))))
        got = lambda s: ends.where(F.endswith("point_id", F.lit(f":{s}"))).select(F.split("point_id", ":")[0].cast("long").alias("request_id"), F.col("node_id").alias(f"{s}_id"), F.struct("node_id", "lat", "lon", "input_type", "snapped", "matched_address", "match_score").alias(f"resolved_{s}"), F.col("error").alias(f"error_{s}"))
        rows = asked.select("request_id", "weather", "error").join(got("origin"), "request_id", "left").join(got("dest"), "request_id", "left")
        over = self.overlay(blocking, flood)
        affected = 0
        if over is not None:
            rows = rows.join(over[1].select(F.col("id").alias("origin_id"), F.lit(True).alias("bo")), "origin_id", "left").join(over[1].select(F.col("id").alias("dest_id"), F.lit(True).alias("bd")), "dest_id", "left")
            affected = over[0].count()
        else:
            rows = rows.withColumns({"bo": F.lit(False), "bd": F.lit(False)})
        error = F.coalesce("error", "error_origin", "error_dest", F.when(F.col("origin_id") == F.col("dest_id"), "origin and destination are the same node"), F.when(F.col("bo"), "origin is blocked"), F.when(F.col("bd"), "destination is blocked"))
        rows = cut(rows.withColumn("error", error).drop("error_origin", "error_dest", "bo", "bd"))
        sound = rows.where("error is null").select("request_id", F.col("origin_id").alias("start"), F.col("dest_id").alias("goal"), "weather")
        found = None
        for weather in WEATHERS:
            batch = sound.where(F.col("weather") == weather)
            if batch.first() is None:
                continue
            got_ = paths.route_features(paths.routes(self.graph, batch, weather, *(over or (None, None))), weather)
            found = got_ if found is None else found.union(got_)
        if found is None:
            return rows.select("request_id", "error", "resolved_origin", "resolved_dest", *(F.lit(None).cast(k).alias(c) for c, k in (("path", "array<long>"), ("distance", "double"), ("minutes", "double"), ("route", "string"))), F.lit(affected).alias("affected_edges"))
        out = rows.join(found.select("request_id", "path", "distance", "minutes", "route"), "request_id", "left")
        out = out.withColumn("error", F.coalesce("error", F.when(F.col("path").isNull(), "no path")))
        return out.select("request_id", "error", "resolved_origin", "resolved_dest", "path", "distance", "minutes", "route", F.lit(affected).alias("affected_edges"))
