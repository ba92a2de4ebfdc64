"""Cheapest paths by balls grown from both ends, for graphs whose edges lead anywhere: there cells have borders everywhere, but few hops join any two nodes.

A round follows, for each request and end, the cheapest nodes not followed yet, FIRST of them and each
round twice as many. Once the cheapest nodes that wait on both sides cost as much together as the best
path that met, it is the cheapest. In such a graph a ball holds about the root of all nodes, where a
search from one end would reach them all. The nodes of a ball are ranked by their request and end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanemesh.lineage import bucketed, cut, drop

FIRST = 256
#: Ties that rounding would lose are kept.
SLACK = 1 + 1e-9
KEY = ["request_id", "back", "node"]


def _costs(rows: DataFrame) -> DataFrame:
    """A row a key: its least cost, and the cost at which it was followed last (null: not yet)."""
    return rows.groupBy(*KEY).agg(F.min("cost").alias("cost"), F.min("done").alias("done"))


def best(state: DataFrame) -> DataFrame:
    """request_id, best: the cost of the cheapest path that met, null if none has; and the least cost that waits on each side (ahead, behind)."""
    side = lambda back: F.min(F.when(F.col("back") == back, F.col("cost")))
    waits = lambda back: F.min(F.when((F.col("back") == back) & F.col("waits"), F.col("cost")))
    rows = state.withColumn("waits", F.col("done").isNull() | (F.col("cost") < F.col("done")))
    by_node = rows.groupBy("request_id", "node").agg((side(False) + side(True)).alias("met"), waits(False).alias("ahead"), waits(True).alias("behind"))
    return by_node.groupBy("request_id").agg(F.min("met").alias("best"), F.min("ahead").alias("ahead"), F.min("behind").alias("behind"))


def grown(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, back (from the goal), node, cost, done of the balls of requests (request_id, start, goal), grown until they hold each cheapest path. edges: src, dst, weight, one a pair."""
    ahead = bucketed(edges.select("src", "dst", "weight"), "src")
    behind = bucketed(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), "src")
    end = lambda name, back: requests.select("request_id", F.lit(back).alias("back"), F.col(name).alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("double").alias("done"))
    state, most = cut(end("start", False).union(end("goal", True))), FIRST
    by_cost = W.partitionBy("request_id", "back").orderBy("cost", "node")
    while True:
        # without a node that waits on the other side, nothing new can meet
        other = F.when(F.col("back"), F.col("ahead")).otherwise(F.col("behind"))
        live = state.where("done is null or cost < done").join(best(state), "request_id")
        live = live.where(other.isNotNull() & (F.col("best").isNull() | (F.col("cost") + other <= F.col("best") * SLACK)))
        chosen = cut(live.withColumn("rank_", F.row_number().over(by_cost)).where(F.col("rank_") <= most).select(*KEY, "cost"))
        if chosen.first() is None:
            drop(chosen)
            return state
        rows = state.union(chosen.withColumn("done", F.col("cost")))
        for back, steps in ((False, ahead), (True, behind)):
            met = chosen.where(F.col("back") == back).withColumnRenamed("node", "src").join(steps, "src")
            rows = rows.union(met.select("request_id", "back", F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.lit(None).cast("double").alias("done")))
        before, state = state, cut(_costs(rows))
        drop(before)
        drop(chosen)
        most *= 2


def tight(edges: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the balls hold of each cheapest path: edges (request_id, src, dst, weight and more) that reach their end at its cost, those of the start's ball and of the goal's; and the nodes where both meet, with their cost from the start."""
    cost = lambda back, name, as_: state.where(F.col("back") == back).select("request_id", F.col("node").alias(name), F.col("cost").alias(as_))
    out = []
    for back, near, far in ((False, "src", "dst"), (True, "dst", "src")):
        followed = state.where((F.col("back") == back) & F.col("done").isNotNull()).select("request_id", F.col("node").alias(near), F.col("cost").alias("before_"))
        met = followed.join(edges, near).join(cost(back, far, "after_"), ["request_id", far])
        out.append(cut(met.where(F.col("before_") + F.col("weight") <= F.col("after_") * SLACK).select("request_id", *edges.columns)))
    both = cost(False, "node", "cost").join(cost(True, "node", "rest_"), ["request_id", "node"]).join(best(state).select("request_id", "best"), "request_id")
    return out[0], out[1], cut(both.where(F.col("cost") + F.col("rest_") <= F.col("best") * SLACK).select("request_id", "node", "cost"))
