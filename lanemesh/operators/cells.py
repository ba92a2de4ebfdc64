"""Cheapest paths over cells of nodes: a task searches a whole cell with a heap, and rounds pass costs over the borders of cells.

Nodes are split into cells of about CELL along a space-filling order, so that few roads leave a cell and a
cell fits a task. The edges of a cell are one row of a table in buckets by cell. A request holds costs for
the nodes by which it entered cells, no others. Each round, the cells whose entries fell are searched from
them, and what lies beyond their borders is offered; rounds follow the cells that a path crosses, not its
hops. Where a path is asked for, each entry's origin is found in one more search of the cells, origins are
traced by doubled pointers, and each leg of a path within a cell is searched once more.

ASKED requests or so meet a cell in one task; a cell that more ask for is read by several tasks.
Where more than ACROSS of the edges lead to other cells, there is no such order, and `balls` serves.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanemesh.functions.geo import haversine
from lanemesh.lineage import bucketed, cut
from lanemesh.operators.rounds import lowest

CELL = 32768
ASKED = 256
ACROSS = 0.5
AT = "struct<cost:double,crossings:int>"
KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def _spread(v: Column) -> Column:
    """The low 16 bits of v, each followed by a zero."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Place on the Z curve over the box (south, west, north, east)."""
    south, west, north, east = box
    part = lambda c, a, b: F.floor((c - a) / max(b - a, 1e-12) * 65535).cast("long")
    return _spread(part(lon, west, east)).bitwiseOR(F.shiftleft(_spread(part(lat, south, north)), 1))


def celled(nodes: DataFrame, size: int = CELL) -> DataFrame:
    """id, lat, lon, cell: ranges of about `size` nodes along the Z curve; in buckets by id."""
    n, *box = nodes.agg(F.count("*"), F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).first()
    rows = nodes.select("id", "lat", "lon")
    if n > size:
        z = morton(F.col("lat"), F.col("lon"), tuple(box))
        rows = rows.withColumn("z", z).repartitionByRange(-(-n // size), "z", "id").withColumn("cell", F.spark_partition_id()).drop("z")
    else:
        rows = rows.withColumn("cell", F.lit(0))
    return bucketed(cut(rows), "id")


@dataclass(frozen=True)
class Cells:
    """nodes: id, lat, lon, cell; edges: cell, and edges from it (src, dst, far: the cell of dst, weight, ord), in buckets by cell."""

    nodes: DataFrame
    edges: DataFrame


def placed(nodes: DataFrame, edges: DataFrame, size: int = CELL) -> tuple[DataFrame, DataFrame]:
    """Nodes in cells, and the edges (src, dst, weight, ord; of parallel ones the cheapest) with the cells that they leave and enter (cell, far)."""
    own = celled(nodes, size)
    best = edges.groupBy("src", "dst").agg(F.min(F.struct("weight", "ord")).alias("e"))
    at = lambda side, name: own.select(F.col("id").alias(side), F.col("cell").alias(name))
    rows = best.join(at("src", "cell"), "src").join(at("dst", "far"), "dst")
    return own, cut(rows.select("cell", "far", "src", "dst", "e.weight", "e.ord"))


def scattered(rows: DataFrame) -> bool:
    """Whether more than ACROSS of the edges lead to other cells."""
    return (rows.agg(F.avg((F.col("cell") != F.col("far")).cast("double"))).first()[0] or 0.0) > ACROSS


def gathered(own: DataFrame, rows: DataFrame) -> Cells:
    """The cells of placed() nodes and edges, a row a cell."""
    return Cells(own, bucketed(rows.groupBy("cell").agg(F.collect_list(F.struct("src", "dst", "far", "weight", "ord")).alias("edges")), "cell"))


class Local:
    """A cell's edges for a heap: those inside it by places of its nodes, those that leave it apart."""

    def __init__(self, cell: int, edges: pa.StructArray):
        get = lambda name: edges.field(name).to_numpy(zero_copy_only=False)
        src, dst, far, weight, order = (get(n) for n in ("src", "dst", "far", "weight", "ord"))
        inside = far == cell
        self.ids = np.unique(np.concatenate((src, dst[inside])))
        place = np.searchsorted(self.ids, src)

        def table(rows: np.ndarray, to: np.ndarray) -> tuple[list, list, list, list]:
            by = np.flatnonzero(rows)[np.argsort(place[rows], kind="stable")]
            return np.searchsorted(place[by], np.arange(len(self.ids) + 1)).tolist(), to[by].tolist(), weight[by].tolist(), order[by].tolist()

        self.inner = table(inside, np.searchsorted(self.ids, dst))
        self.outer = table(~inside, dst)

    def place(self, node: int) -> int | None:
        i = int(np.searchsorted(self.ids, node))
        return i if i < len(self.ids) and self.ids[i] == node else None

    def search(self, starts: list[tuple[int, float, int]], goal: int | None = None, limit: float | None = None) -> tuple[dict, dict]:
        """(cost, crossings) of the places settled, in order, and for each the place and edge before it, or its own start; from starts (place, cost, crossings), until the goal is settled or costs pass the limit."""
        begin, to, weight, order = self.inner
        best: dict[int, tuple[float, int]] = {}
        before: dict[int, tuple[int, int | None, int]] = {}
        heap = []
        for p, cost, crossings in starts:
            if p not in best or (cost, crossings) < best[p]:
                best[p], before[p] = (cost, crossings), (p, None, p)
                heap.append((cost, crossings, p))
        heapq.heapify(heap)
        settled: dict[int, tuple[float, int]] = {}
        while heap:
            cost, crossings, p = heapq.heappop(heap)
            if p in settled:
                continue
            if limit is not None and cost > limit:
                break
            settled[p] = (cost, crossings)
            if p == goal:
                break
            for k in range(begin[p], begin[p + 1]):
                q, more = to[k], (cost + weight[k], crossings)
                if q not in settled and (q not in best or more < best[q]):
                    best[q], before[q] = more, (p, order[k], before[p][2])
                    heapq.heappush(heap, (*more, q))
        return settled, before

    def beyond(self, settled: dict) -> Iterator[tuple[int, float, int, int, int]]:
        """Nodes over the border with cost, crossings, the place they are left from, and the edge."""
        begin, to, weight, order = self.outer
        for p, (cost, crossings) in settled.items():
            for k in range(begin[p], begin[p + 1]):
                yield to[k], cost + weight[k], crossings + 1, p, order[k]


def _by_request(asks: list[dict]) -> dict:
    out: dict = {}
    for a in asks:
        out.setdefault(a["request_id"], []).append(a)
    return out


def _meet(cells: Cells, rows: DataFrame, deals: int, ask: list[str], run: Callable, schema: str) -> DataFrame:
    """run(local, request, its rows) for rows (request_id, cell and the columns ask), each cell with about ASKED requests at a time."""
    deal = F.pmod(F.xxhash64("request_id"), F.lit(deals)).cast("int")
    grouped = rows.groupBy("cell", deal.alias("deal")).agg(F.collect_list(F.struct("request_id", *ask)).alias("asks"))
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
    types = [KINDS[k] for k in kinds]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                local = Local(batch.column("cell")[i].as_py(), batch.column("edges")[i].values)
                out = [row for request, own in _by_request(batch.column("asks")[i].as_py()).items() for row in run(local, request, own)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], list(names))

    return cells.edges.join(grouped, "cell").mapInArrow(search, schema)


def costs(cells: Cells, requests: DataFrame, rate: float) -> DataFrame:
    """request_id, node, at (cost, crossings) of the nodes by which requests (request_id, start, goal) enter cells, and of their goals. rate: least cost of a metre."""
    kind = requests.schema["request_id"].dataType.simpleString()
    deals = max(1, -(-requests.count() // ASKED))
    place = cells.nodes.select(F.col("id").alias("goal"), F.col("lat").alias("glat"), F.col("lon").alias("glon"))
    goals = cut(requests.select("request_id", "goal").join(place, "goal"))
    ends = goals.select("request_id", F.col("goal").alias("node"))

    def run(local, request, own):
        goal, limit = local.place(own[0]["goal"]), own[0]["best"]
        starts = [(p, a["cost"], a["crossings"]) for a in own if (p := local.place(a["node"])) is not None]
        settled, _ = local.search(starts, goal, limit)
        if goal in settled:
            yield request, own[0]["goal"], *settled[goal]
        least: dict[int, tuple[float, int]] = {}
        for node, cost, crossings, _, _ in local.beyond(settled):
            if (limit is None or cost <= limit) and (node not in least or (cost, crossings) < least[node]):
                least[node] = (cost, crossings)
        for node, at in least.items():
            yield request, node, *at

    def offers(frontier: DataFrame, state: DataFrame) -> DataFrame:
        best = state.join(ends, ["request_id", "node"], "left_semi").groupBy("request_id").agg(F.min("at.cost").alias("best"))
        live = frontier.join(goals, "request_id").where("node != goal").join(best, "request_id", "left").join(cells.nodes.select(F.col("id").alias("node"), "lat", "lon", "cell"), "node")
        # a little slack keeps ties that rounding would lose
        bound = F.col("at.cost") + rate * haversine(F.col("lat"), F.col("lon"), F.col("glat"), F.col("glon"))
        live = live.where(F.col("best").isNull() | (bound <= F.col("best") * (1 + 1e-9))).select("request_id", "cell", "node", "at.cost", "at.crossings", "goal", "best")
        found = _meet(cells, live, deals, ["node", "cost", "crossings", "goal", "best"], run, f"request_id {kind}, node long, cost double, crossings int")
        return found.select("request_id", "node", F.struct("cost", "crossings").alias("at"))

    zero = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("crossings")).cast(AT)
    return lowest(requests.select("request_id", F.col("start").alias("node"), zero.alias("at")), ["request_id", "node"], "at", offers)


def origins(cells: Cells, requests: DataFrame, found: DataFrame) -> DataFrame:
    """request_id, node, parent and edge (cell, entry, exit, ord) of found (request_id, node, at) for requests that reach their goal: the entry that it was reached from, by which exit and over which edge; ties to the least."""
    kind = requests.schema["request_id"].dataType.simpleString()
    deals = max(1, -(-requests.count() // ASKED))
    reached = requests.select("request_id", "goal").join(found.select("request_id", F.col("node").alias("goal"), F.col("at.cost").alias("best")), ["request_id", "goal"])
    rows = found.join(reached, "request_id").where("node != goal and at.cost <= best").join(cells.nodes.select(F.col("id").alias("node"), "cell"), "node")
    rows = rows.select("request_id", "cell", "node", "at.cost", "at.crossings", "goal", "best")

    def run(local, request, own):
        limit, goal = own[0]["best"], local.place(own[0]["goal"])
        starts = [(p, a["cost"], a["crossings"]) for a in own if (p := local.place(a["node"])) is not None]
        settled, before = local.search(starts, None, limit)
        name = lambda p: int(local.ids[p])
        if goal in settled:
            yield request, own[0]["goal"], *settled[goal], name(before[goal][2]), name(goal), None, own[0]["cell"]
        for node, cost, crossings, p, order in local.beyond(settled):
            if cost <= limit:
                yield request, node, cost, crossings, name(before[p][2]), name(p), order, own[0]["cell"]

    made = _meet(cells, rows, deals, ["node", "cost", "crossings", "goal", "best", "cell"], run, f"request_id {kind}, node long, cost double, crossings int, entry long, exit long, ord long, cell int")
    made = made.join(found, ["request_id", "node"]).where("cost = at.cost and crossings = at.crossings and entry != node")
    best = made.groupBy("request_id", "node").agg(F.min(F.struct("entry", "exit", "ord", "cell")).alias("edge"))
    return best.select("request_id", "node", F.col("edge.entry").alias("parent"), "edge")


def legs(cells: Cells, requests: DataFrame, traced: DataFrame) -> DataFrame:
    """request_id, step, ord of the edges of paths whose origins are traced (request_id, step, edge); step: legs back from the goal, then edges back from the leg's end."""
    kind = requests.schema["request_id"].dataType.simpleString()
    deals = max(1, -(-requests.count() // ASKED))
    rows = traced.select("request_id", F.col("edge.cell").alias("cell"), "step", "edge.entry", "edge.exit", "edge.ord")

    def run(local, request, own):
        for a in own:
            entry, exit_ = local.place(a["entry"]), local.place(a["exit"])
            _, before = local.search([(entry, 0.0, 0)], exit_)
            steps, p = [] if a["ord"] is None else [a["ord"]], exit_
            while before[p][1] is not None:
                steps.append(before[p][1])
                p = before[p][0]
            for k, order in enumerate(steps):
                yield request, a["step"], k, order

    made = _meet(cells, rows, deals, ["step", "entry", "exit", "ord"], run, f"request_id {kind}, leg int, k int, ord long")
    return made.select("request_id", F.struct("leg", "k").alias("step"), "ord")
