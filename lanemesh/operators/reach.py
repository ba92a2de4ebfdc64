"""What can be reached, in rounds that grow with the logarithm of the longest path where the graph is made of roads.

Nodes that roads join both ways can all reach each other, so they are contracted to one; that leaves the
one-way part. There, a node that is entered from one other node only is reached if that one is: such
nodes are contracted along their chains by doubled pointers. What is left is searched by its frontier.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanemesh.lineage import cut
from lanemesh.operators.rounds import MOST_TABLES


def connected(pairs: DataFrame) -> DataFrame:
    """id, group (its least id) of the nodes of pairs (a, b), whichever way they are joined.

    Each round every node goes to the neighbour of least hash, and on to where that goes; then what was joined is contracted. About a third of the nodes are left after a round, whatever the order of their ids."""
    now = cut(pairs.where("a != b").select("a", "b").distinct())
    labels = None
    while now.first() is not None:
        both = now.union(now.select("b", "a"))
        key = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("node"))
        step = both.groupBy("a").agg(F.min(key("b")).alias("least")).select(F.col("a").alias("id"), F.least(key("a"), F.col("least")).getField("node").alias("to"))
        step = cut(step)
        on = step.select(F.col("id").alias("to"), F.col("to").alias("next"))
        step = step.join(on, "to").select("id", F.col("next").alias("to"))
        if labels is None:
            labels = step.withColumnRenamed("to", "group")
        else:
            labels = labels.join(step.withColumnRenamed("id", "group"), "group", "left").select("id", F.coalesce("to", "group").alias("group"))
        ends = lambda side: step.select(F.col("id").alias(side), F.col("to").alias(f"{side}2"))  # noqa: B023, E731
        now = cut(now.join(ends("a"), "a").join(ends("b"), "b").where("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    if labels is None:
        return now.select(F.col("a").alias("id"), F.col("b").alias("group"))
    labels = cut(labels)
    least = labels.groupBy("group").agg(F.min("id").alias("least"))
    return labels.join(least, "group").select("id", F.col("least").alias("group"))


def mutual(edges: DataFrame) -> DataFrame:
    """id, group of the nodes that have edges both ways with another; edges: src, dst, distinct."""
    there = edges.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.where("src > dst").select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return cut(connected(there.join(back, ["a", "b"], "left_semi")))


def contracted(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """The distinct edges between groups; a node without a group stands for itself."""
    at = lambda side: groups.select(F.col("id").alias(side), F.col("group").alias(f"{side}_"))
    both = edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    return both.select(F.coalesce("src_", "src").alias("src"), F.coalesce("dst_", "dst").alias("dst")).where("src != dst").distinct()


def heads(edges: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """id, group of the nodes with one node before them: the first node up their chain that has none or several, or is in fixed (column id).

    On a ring of such nodes the chain ends at its least node, which stands for itself. Pointers are doubled."""
    one = edges.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("to"), F.count("*").alias("n")).where("n = 1").select("id", "to")
    if fixed is not None:
        one = one.join(fixed.select("id"), "id", "left_anti")
    one = cut(one)
    found, rest = _doubled(one)
    if rest is None:
        return found
    ends = rest.where("id = least").select("id")
    again, _ = _doubled(cut(one.join(ends, "id", "left_anti")))
    return again


def _doubled(one: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """id, group after following the pointers (id, to) to their ends; and the rows that have none, with the least id that they pass."""
    now, passed, total = one.withColumn("least", F.col("id")), 1, one.count()
    while True:
        after = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("least").alias("least2"))
        both = cut(now.join(after, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.least("least", "least2").alias("least"), F.col("next").isNull().alias("ended")))
        done, left = both.where("ended").select("id", F.col("to").alias("group")), both.where("not ended")
        if left.first() is None:
            return done, None
        if passed > total:
            return done, left.select("id", "least")
        passed *= 2
        now = both.select("id", "to", "least")


def spread(steps: DataFrame, start: DataFrame) -> DataFrame:
    """Column id of what start (column id) reaches over steps (src, dst), a round a hop; a round joins the frontier alone, and every MOST_TABLES rounds their tables are folded into one."""
    seen = frontier = cut(start.select("id").distinct())
    tables = 1
    while frontier.first() is not None:
        found = steps.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = cut(found.join(seen, "id", "left_anti"))
        seen, tables = seen.union(frontier), tables + 1
        if tables == MOST_TABLES:
            seen, tables = cut(seen), 1
    return seen


def reachable(edges: DataFrame, start: DataFrame, backward: bool = False) -> DataFrame:
    """Column id of the nodes that can be reached from start (column id), or reach it. edges: src, dst and more."""
    steps = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backward else edges.select("src", "dst")
    steps = cut(steps.where("src != dst").distinct())
    groups = mutual(steps)
    core = cut(contracted(steps, groups))
    first = cut(start.select("id").distinct().join(groups, "id", "left").select("id", F.coalesce("group", "id").alias("top")))
    tops = first.select(F.col("top").alias("id")).distinct()
    chains = cut(heads(core, tops))
    inner = cut(core.join(chains.select(F.col("id").alias("dst")), "dst", "left_anti"))
    inner = cut(inner.join(chains.select(F.col("id").alias("src"), "group"), "src", "left").select(F.coalesce("group", "src").alias("src"), "dst").where("src != dst").distinct())
    seen = cut(spread(inner, tops))
    seen = seen.union(chains.join(seen.withColumnRenamed("id", "group"), "group", "left_semi").select("id"))
    members = groups.join(seen.withColumnRenamed("id", "group"), "group", "left_semi").select("id")
    return cut(seen.union(members).union(first.select("id")).distinct())


class Condensed(NamedTuple):
    """members: id, top (what the node was contracted to); nodes: id, size; edges between them: src, dst."""

    members: DataFrame
    nodes: DataFrame
    edges: DataFrame


def condensed(nodes: DataFrame, edges: DataFrame) -> Condensed:
    """nodes (column id) with those contracted that edges join both ways."""
    steps = cut(edges.select("src", "dst").where("src != dst").distinct())
    groups = mutual(steps)
    members = cut(nodes.select("id").join(groups, "id", "left").select("id", F.coalesce("group", "id").alias("top")))
    return Condensed(members, cut(members.groupBy(F.col("top").alias("id")).agg(F.count("*").alias("size"))), cut(contracted(steps, groups)))


def without_ends(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without the nodes that are on no ring because nothing comes into them or their chain, or nothing goes out of it; until there are none. A chain goes in one round."""
    while True:
        before = nodes.count()
        for a, b in (("src", "dst"), ("dst", "src")):
            steps = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
            no_entry = nodes.select("id").join(steps.select(F.col("dst").alias("id")), "id", "left_anti")
            no_entry = cut(no_entry)
            if no_entry.first() is None:
                continue
            chains = heads(steps)
            dead = cut(no_entry.union(chains.join(no_entry.withColumnRenamed("id", "group"), "group", "left_semi").select("id")))
            nodes = cut(nodes.join(dead, "id", "left_anti"))
            edges = cut(edges.join(dead.withColumnRenamed("id", "src"), "src", "left_anti").join(dead.withColumnRenamed("id", "dst"), "dst", "left_anti"))
        if nodes.count() == before:
            return nodes, edges
