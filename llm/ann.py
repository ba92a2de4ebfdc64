"""Approximate nearest neighbours by largest inner product, with shifted space-filling curves.

Vectors get one more coordinate that gives all the same norm, so the largest inner product with a
query is the nearest point (Bachrach et al., "Speeding up the Xbox recommender system"). In each of
ORDERINGS orderings they are projected to PROJECTED random directions, laid on a grid of quantiles
with a random shift, and numbered along a Hilbert curve; Spark range-partitions the keys. A query
looks at the 2 * HALF rows around its key, a number that doesn't grow with the table; the windows of
all orderings are merged and reranked by exact inner products, ties to the smaller id.

Windows are cut from blocks of BLOCK rows, each with the 2 * HALF rows that follow it. A task holds
one block at a time and streams the queries of it by; a block with many queries is read by several
tasks, about DEAL queries each.

Blocks hold codes: a byte a component, with their scale and their distance from the vector. That distance
bounds how far a score by code can be from the exact one, so a window keeps every point that could be among
the nearest, and so do the merged windows. Whole vectors are fetched for those few alone: the result is that
of exact scores of all rows looked at.

The quantiles come from a bounded sample: the SAMPLE vectors of least hash. All vectors are indexed.
Recall is measured in the tests and the README.

Equal vectors are one point with its MOST_IDS least ids, which suffice for any query's TOP nearest.
Vectors null, zero, holding null or non-finite components, or without id take no part. Vectors of
different lengths have no inner product: each length is a search of its own. Repeated rows count
once. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.groups import grouped, join_dealt
from llm.tables import keep, release

TOP = 20
MOST_IDS = TOP + 1
ORDERINGS = 64
PROJECTED = 12
BITS = 3
SAMPLE = 4096
HALF = 224
BLOCK = 4096
DEAL = 2048
#: Room for rounding between a product of matrices and the exact sum of products.
ROUNDING = 1e-9


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on a Hilbert curve of each row of cells, integers below 2 ** bits (Skilling, "Programming the Hilbert curve")."""
    axes = [c.astype(np.int64) for c in cells.T]
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i in range(len(axes)):
            high = (axes[i] & q) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & p)
            axes[0] = np.where(high, axes[0] ^ p, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for a in axes:
            key = key << 1 | ((a ^ turn) >> level & 1)
    return key


def pack(x: np.ndarray) -> bytes:
    """A vector as bytes of singles if those hold it exactly, else of doubles."""
    with np.errstate(over="ignore"):
        single = x.astype("<f4")
    return single.tobytes() if (single == x).all() else x.tobytes()


def unpack(column, size: int) -> np.ndarray:
    """Rows of doubles from vectors of `size` components."""
    rows = column.to_pylist()
    if all(len(r) == 4 * size for r in rows):
        return np.frombuffer(b"".join(rows), "<f4").reshape(-1, size).astype(float)
    return np.stack([np.frombuffer(r, "<f4" if len(r) == 4 * size else "<f8") for r in rows]).astype(float)


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (the packed components), size, norm2: the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = v.values
                if i is None or x is None or not len(x) or x.null_count:
                    continue
                x = x.to_numpy(zero_copy_only=False).astype("<f8")
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    rows.append(x + 0.0)  # no negative zeros: equal vectors have equal bytes
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([pack(x) for x in rows], pa.binary()), pa.array([len(x) for x in rows], pa.int32()), pa.array([float(x @ x) for x in rows], pa.float64())],
                ["vec_id", "v", "size", "norm2"],
            )

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, v binary, size int, norm2 double")


class Curves:
    """The orderings' projections, quantiles and shifts; fitted on a sample of vectors."""

    def __init__(self, sample: np.ndarray, largest: float, orderings: int = ORDERINGS, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.largest = largest
        points = self.points(sample, False)
        width = min(PROJECTED, points.shape[1])
        self.directions = [np.linalg.qr(rng.normal(size=(points.shape[1], width)))[0] for _ in range(orderings)]
        self.quantiles = [np.sort(points @ d, axis=0) for d in self.directions]
        self.shifts = rng.random((orderings, width))

    def points(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors on the sphere where inner products become distances."""
        norms = np.linalg.norm(x, axis=1)
        if query:
            return np.concatenate((x / norms[:, None], np.zeros((len(x), 1))), axis=1)
        x = x / self.largest
        return np.concatenate((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]), axis=1)

    def keys(self, points: np.ndarray, o: int) -> np.ndarray:
        flat, sample = points @ self.directions[o], self.quantiles[o]
        share = np.stack([np.searchsorted(sample[:, j], flat[:, j]) for j in range(flat.shape[1])], axis=1) / max(1, len(sample))
        cells = np.floor(share * (2**BITS - 1) * (1 - 1e-9) + self.shifts[o]).astype(np.int64)
        return hilbert_keys(np.clip(cells, 0, 2**BITS - 1), BITS)


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the points of each ordering in one sorted partition: local counts the points before the row."""
    count, now = 0, None
    for batch in batches:
        o, query = batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
        local = np.empty(len(o), np.int64)
        for at in np.split(np.arange(len(o)), np.flatnonzero(np.diff(o)) + 1):
            if not len(at):
                continue
            if o[at[0]] != now:
                now, count = o[at[0]], 0
            own = (~query[at]).astype(np.int64)
            local[at] = count + np.cumsum(own) - own
            count += int(own.sum())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(local)], ["o", "uid", "is_query", "pid", "local"])


def encode(x: np.ndarray) -> np.ndarray:
    """Rows of bytes: the scale, an upper bound of the distance, and a signed byte a component."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        scale = np.abs(x).max(axis=1) / 127
        whole = np.clip(np.rint(x / np.where(scale > 0, scale, 1)[:, None]), -127, 127)
        far = np.sqrt(((x - whole * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-150
    # squares may vanish or be too large for doubles: the former counts as a little, the latter as no bound at all
    head = np.stack((scale, np.where(np.isfinite(far), far, np.inf)), axis=1).astype("<f8")
    return np.concatenate((head.view(np.uint8), whole.astype(np.int8).view(np.uint8)), axis=1)


def decode(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors near those encoded, and how near."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 16 + size)
    head = np.ascontiguousarray(raw[:, :16]).view("<f8")
    return np.ascontiguousarray(raw[:, 16:]).view(np.int8) * head[:, :1], head[:, 1]


def possible(scores: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of scores, each known up to `far`, that may be among the MOST_IDS greatest."""
    if len(scores) <= MOST_IDS:
        return np.arange(len(scores))
    low = np.nan_to_num(scores - far, nan=-np.inf)
    return np.flatnonzero(~(scores + far < np.partition(low, -MOST_IDS)[-MOST_IDS]))


_LISTS = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float32()))


def _search(batches: Iterator[pa.RecordBatch], size: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Blocks' codes, each followed by the queries that look there, to what may be nearest in the queries' windows."""
    now, held, codes, far, uids, first = None, [], None, None, None, 0
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("o", "block", "part", "is_query")]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for at, to in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if at == to:
                continue
            run, key = batch.slice(at, to - at), tuple(int(c[at]) for c in columns[:3])
            if key != now:
                now, held, codes = key, [], None
            if not columns[3][at]:
                held.append(run)
                continue
            if codes is None:
                table = pa.Table.from_batches(held)
                (codes, far), uids, first, held = decode(table.column("data"), size), table.column("uid").to_numpy(), table.column("place")[0].as_py(), []
            queries, rows = unpack(run.column("data"), size), []
            for uid, place, query in zip(run.column("uid").to_pylist(), run.column("place").to_pylist(), queries, strict=True):
                own = slice(place - first, place - first + wide)
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = codes[own] @ query
                    bound = far[own] * np.linalg.norm(query) + ROUNDING * np.abs(scores).max(initial=0.0)
                    single = np.nextafter(bound.astype(np.float32), np.float32(np.inf))
                found = possible(scores, bound)
                rows.append((uid, uids[own][found], scores[found], single[found]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LISTS, strict=True)], ["uid", "found", "scores", "far"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What may be nearest in all windows of a query together."""
    for group in grouped(batches, ["uid"]):
        flat = [np.concatenate([np.asarray(v.values) for v in group.column(c)]) for c in ("found", "scores", "far")]
        uids, at = np.unique(flat[0], return_index=True)
        own = uids[possible(flat[1][at], flat[2][at].astype(float))]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), group.column("uid")[0].as_py())), pa.array(own)], ["query", "uid"])


def _exact(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The MOST_IDS nearest ids of each query, by exact score and then id; a query's own vector comes ahead of its candidates."""
    rows = []
    for group in grouped(batches, ["query"]):
        x, ids = unpack(group.column("v"), size), group.column("ids").to_pylist()
        scores = (x[1:] * x[0]).sum(axis=1)
        found = sorted((-float(s), i) for s, own in zip(scores, ids[1:], strict=True) for i in own)[:MOST_IDS]
        rows.append((group.column("v")[0].as_py(), [i for _, i in found], [-s for s, _ in found]))
        if len(rows) == 256:
            yield _found(rows)
            rows = []
    if rows:
        yield _found(rows)


def _found(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64())), strict=True)], ["v", "found", "scores"])


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, every: int = 20, orderings: int = ORDERINGS, half: int = HALF) -> DataFrame:
    """query_id, rank, vec_id, score: the TOP nearest found of each vector whose id `every` divides."""
    base = keep(_valid(vectors), "ann-v")
    out = vectors.sparkSession.createDataFrame([], RESULT)
    for row in base.select("size").distinct().orderBy("size").collect():
        out = out.union(_search_length(base.where(F.col("size") == row[0]), row[0], every, orderings, half))
    return out


def _search_length(base: DataFrame, size: int, every: int, orderings: int, half: int) -> DataFrame:
    spark = base.sparkSession
    base = base.dropDuplicates(["vec_id", "v"])
    few = base.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= MOST_IDS)
    few = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("uid"), F.max("norm2").alias("norm2"))
    asked = base.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    points = few.join(asked.select("v").distinct().withColumn("asked", F.lit(True)), "v", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    # a vector id may stand for several different vectors: number the points by id and a hash
    points = points.withColumn("uid", F.xxhash64("uid", "v"))

    def coded(batches):
        for batch in batches:
            codes = [c.tobytes() for c in encode(unpack(batch.column(1), size))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], [*batch.schema.names, "code"])

    points = points.select("uid", "v", "ids", "norm2", "asked").mapInArrow(coded, "uid long, v binary, ids array<long>, norm2 double, asked boolean, code binary")
    points = keep(points, "ann-p")
    n, largest = points.agg(F.count("*"), F.max("norm2")).first()
    sample = points.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("v").toArrow()
    curves = Curves(unpack(sample.column("v"), size), float(np.sqrt(largest)), orderings)

    def keyed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpack(batch.column(1), size)
            asks = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            own, theirs = curves.points(x, False), curves.points(x[asks], True)
            uids = batch.column(0).to_numpy()
            for o in range(orderings):
                keys = np.concatenate((curves.keys(own, o), curves.keys(theirs, o)))
                both = np.concatenate((uids, uids[asks]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), o, np.int32)), pa.array(keys), pa.array(both), pa.array(np.arange(len(keys)) >= len(own))], ["o", "key", "uid", "is_query"])

    rows = points.select("uid", "v", "asked").mapInArrow(keyed, "o int, key long, uid long, is_query boolean")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "o", "key", "uid", "is_query").sortWithinPartitions("o", "key", "uid", "is_query")
    rows = rows.withColumn("pid", F.spark_partition_id()).mapInArrow(_positions, "o int, uid long, is_query boolean, pid int, local long")
    placed = rows = keep(rows, "ann-r")
    totals = rows.groupBy("o", "pid").agg(F.sum((~F.col("is_query")).cast("long")).alias("t"))
    offsets = totals.select("o", "pid", F.coalesce(F.sum("t").over(W.partitionBy("o").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    wide = min(2 * half, n)
    at, size_ = F.col("local") + F.col("offset"), max(BLOCK, 2 * wide)
    # a query is placed where its window begins, so that one block and what follows it hold the window
    at = F.when(F.col("is_query"), F.least(F.greatest(at - half, F.lit(0)), F.lit(n - wide))).otherwise(at)
    rows = rows.join(offsets, ["o", "pid"]).select("o", "uid", "is_query", at.alias("place")).withColumn("block", F.expr(f"place div {size_}"))
    before = (F.col("place") % size_ < wide) & (F.col("block") > 0) & ~F.col("is_query")
    rows = rows.withColumn("block", F.explode(F.when(before, F.array(F.col("block") - 1, "block")).otherwise(F.array("block"))))
    deals = rows.where("is_query").groupBy("o", "block").agg(F.ceil(F.count("*") / DEAL).cast("long").alias("deals"))
    every_part = F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)
    part = F.explode(F.when(F.col("is_query"), F.array(F.pmod(F.xxhash64("uid"), F.col("deals")))).otherwise(every_part))
    rows = rows.join(deals, ["o", "block"]).select("o", "uid", "is_query", "place", "block", part.alias("part"))
    data = F.when(F.col("is_query"), F.col("v")).otherwise(F.col("code"))
    rows = rows.join(points.select("uid", "v", "code"), "uid").select("o", "uid", "is_query", "place", "block", "part", data.alias("data"))
    rows = rows.repartition("o", "block", "part").sortWithinPartitions("o", "block", "part", "is_query", "place")
    found = rows.mapInArrow(lambda b: _search(b, size, wide), "uid long, found array<long>, scores array<double>, far array<float>")
    pairs = keep(found.repartition("uid").sortWithinPartitions("uid").mapInArrow(_merge, "query long, uid long"), "ann-c")
    release(placed)
    # a long vector may be near to every query
    counts = pairs.groupBy("uid").agg(F.count("*").alias("n"))
    met = join_dealt(pairs, points.select("uid", "v", "ids"), "uid", "query", counts, pairs.count())
    met = met.select("query", F.lit(1).alias("turn"), "v", "ids").union(points.where("asked").select("uid", F.lit(0), "v", F.array().cast("array<long>")))
    met = met.repartition("query").sortWithinPartitions("query", "turn")
    found = met.mapInArrow(lambda b: _exact(b, size), "v binary, found array<long>, scores array<double>")
    found = keep(found.select("v", F.arrays_zip("found", "scores").alias("z")), "ann-f")
    release(pairs)
    # one vector may be very common among those that ask
    salts = 16
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    out = asked.join(found, ["v", "salt"]).select(F.col("vec_id").alias("query_id"), "z")
    out = out.select("query_id", F.posexplode(F.slice(F.filter("z", lambda x: x["found"] != F.col("query_id")), 1, TOP)))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.found").alias("vec_id"), F.col("col.scores").alias("score"))


def recall(found: dict[int, list[int]], ids: np.ndarray, x: np.ndarray) -> float:
    """Share of the true TOP nearest that were found."""
    order, hits, total = np.argsort(ids, kind="stable"), 0, 0
    ids, x = ids[order], x[order]
    for q, got in found.items():
        own = int(np.flatnonzero(ids == q)[0])
        scores = x @ x[own]
        best = [int(ids[i]) for i in np.argsort(-scores, kind="stable") if i != own][:TOP]
        hits, total = hits + len(set(best) & set(got)), total + len(best)
    return hits / max(1, total)
