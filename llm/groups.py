"""Groups of rows in sorted partitions, without holding a partition; and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tables import keep


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the keys (numbers without nulls), from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        if last is not None and tuple(v[0] for v in values) != last:
            new[0] = True
        last = tuple(v[-1] for v in values)
        at = 0
        for i in np.flatnonzero(new):
            held.append(batch.slice(at, i - at))
            at = int(i)
            if sum(b.num_rows for b in held):
                yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges from the first of each connected component of a symmetric Boolean matrix to its others."""
    n, seen, out = len(near), np.zeros(len(near), bool), []
    for i in range(n):
        if seen[i]:
            continue
        seen[i] = True
        wave = near[i] & ~seen
        while wave.any():
            seen |= wave
            own = np.flatnonzero(wave)
            out += [(i, int(j)) for j in own]
            wave = near[own].any(axis=0) & ~seen
    return out


#: A key is hot with more than this share of the rows; there are fewer than its inverse.
HOT = 1 / 1000
DEALT = 64


def join_dealt(left: DataFrame, right: DataFrame, key: str, by: str, counts: DataFrame, total: int) -> DataFrame:
    """left joined with right, which has a row a key at most; rows of hot keys are dealt to DEALT tasks by the column `by`.

    counts: key and n, of left's rows, which are `total`. The hot keys are fewer than 1 / HOT, so they are broadcast."""
    hot = F.broadcast(counts.where(F.col("n") > max(1000, total * HOT)).select(key, F.lit(True).alias("hot_")))
    left = left.join(hot, key, "left").withColumn("deal_", F.when(F.col("hot_"), F.pmod(F.xxhash64(by), F.lit(DEALT))).otherwise(0).cast("int")).drop("hot_")
    every = F.when(F.col("hot_"), F.sequence(F.lit(0), F.lit(DEALT - 1))).otherwise(F.array(F.lit(0)))
    right = right.join(hot, key, "left").withColumn("deal_", F.explode(every)).drop("hot_")
    return left.join(right, [key, "deal_"]).drop("deal_")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node and component (its least node, as the nodes' order goes) of the edges a, b. Nodes should be hashes: then rounds are about the logarithm of the longest path.

    Each round sends every node to its least neighbour and contracts; nothing is collected but counts."""
    now = edges.where("a != b").select("a", "b").distinct()
    now = keep(now, f"{name}-e")
    labels = None
    while now.first() is not None:
        both = now.select("a", "b").union(now.select("b", "a"))
        step = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        step = keep(step, f"{name}-s")
        if labels is None:
            labels = step.select("node", F.col("to").alias("component"))
        else:
            labels = labels.join(step.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = keep(labels, f"{name}-l")
        to_a, to_b = step.select(F.col("node").alias("a"), F.col("to").alias("a2")), step.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        now = now.join(to_a, "a").join(to_b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a != b").distinct()
        now = keep(now, f"{name}-e")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
