"""Lookups by id in batches: nodes, neighbours and addresses, stored in buckets by id with Bloom filters.

A batch given as a table of ids is joined with the buckets, which aren't shuffled. A short list of ids
reads the buckets of those ids alone, and of these the files whose filter doesn't rule all of them out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanemesh.lineage import bucketed
from lanemesh.schemas import Graph

Ids = DataFrame | list[int]


@dataclass(frozen=True)
class Store:
    """nodes: id, lat, lon; neighbours: id, neighbours (the node's edges in adjacency order, with dst); addresses: the first address of each node_id, or None."""

    nodes: DataFrame
    neighbours: DataFrame
    addresses: DataFrame | None


def store(graph: Graph, addresses: DataFrame | None = None) -> Store:
    edge = F.struct("ord", "dst", *(c for c in graph.edges.columns if c not in ("ord", "src", "dst")))
    near = graph.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(edge)).alias("neighbours"))
    first = None
    if addresses is not None:
        row = F.struct(*(c for c in addresses.columns if c != "node_id"))
        first = addresses.groupBy("node_id").agg(F.min_by(row, "id").alias("a")).select("node_id", "a.*")
        first = bucketed(first, "node_id", bloom="node_id")
    return Store(bucketed(graph.nodes, "id", bloom="id"), bucketed(near, "id", bloom="id"), first)


def _find(table: DataFrame, ids: Ids, key: str) -> DataFrame:
    if isinstance(ids, list):
        return table.where(F.col(key).isin(ids))
    return table.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def nodes(held: Store, ids: Ids) -> DataFrame:
    """id, lat, lon of the nodes that are there; ids: a list, or a table with a column id."""
    return _find(held.nodes, ids, "id")


def has_nodes(held: Store, ids: DataFrame) -> DataFrame:
    """id, known for every distinct id."""
    return ids.select("id").distinct().join(held.nodes.select("id", F.lit(True).alias("known")), "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))


def neighbours(held: Store, ids: Ids) -> DataFrame:
    """id, neighbours of the nodes that have edges."""
    return _find(held.neighbours, ids, "id")


def address_of(held: Store, ids: Ids) -> DataFrame:
    """node_id and the first address, by id, of the nodes that have one."""
    return _find(held.addresses, ids, "node_id")
