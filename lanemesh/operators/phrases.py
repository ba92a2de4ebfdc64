"""Phrase search for batches of queries that a good part of all texts answers, without an index.

An index by token serves queries with few hits. Here the hits are queries times texts, so nothing may be kept or
shuffled for each of them: texts are dealt over the tasks once, every task also gets all queries, ahead of its texts,
and hits leave it as they are found, some texts at a time. A relevance needs the rows that a query hits, so it takes
two such passes: the first returns counts, the second the rows, or the best of each query.

Equal queries are one ask. In a task, the tokens of some texts are numbered in order, so that those which a prefix
begins stand together; tokens sorted with their followers give the places of an ask's last two tokens as one run.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanemesh.functions import text
from lanemesh.lineage import cut

#: Tokens of texts that are looked at together, places of asks in arrays at a time, and rows that leave a task at a time.
WORDS, PLACES, OUT = 1_000_000, 2_000_000, 250_000
#: Candidates for the best of an ask that wait until they are ranked.
WAITING = 500_000
#: Follows every token that a prefix begins.
AFTER = "\U0010ffff"


class Asks(NamedTuple):
    """Different asks in a task: their numbers and tokens; rows: the queries, owners of them by ask, of the k-th from starts[k] on."""

    numbers: np.ndarray
    tokens: list[list[str]]
    rows: pa.Table
    owners: np.ndarray
    starts: np.ndarray


class Piece(NamedTuple):
    """Some texts: their rows and how many tokens each has."""

    rows: pa.RecordBatch
    sizes: np.ndarray


#: Places of asks and of a piece's rows that they hit, and how often, some asks at a time.
Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]
#: What a task makes of its asks and of its pieces with their hits.
Made = Callable[[Asks, Iterator[tuple[Piece, Found]]], Iterator[pa.RecordBatch]]


def _asks(batches: list[pa.RecordBatch]) -> Asks:
    rows = pa.Table.from_batches(batches)
    numbers, first, owner = np.unique(rows["ask"].to_numpy(), return_index=True, return_inverse=True)
    owners = np.argsort(owner, kind="stable")
    return Asks(numbers, rows["tokens"].take(pa.array(first)).to_pylist(), rows, owners, np.searchsorted(owner[owners], np.arange(len(numbers) + 1)))


def _pieces(batch: pa.RecordBatch) -> Iterator[Piece]:
    sizes = np.diff(batch.column("tokens").offsets.to_numpy())
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // WORDS
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if sizes[a:b].any():
            yield Piece(batch.slice(a, b - a), sizes[a:b])


def _found(piece: Piece, asks: Asks) -> Found:
    """The rows that hold an ask's tokens in a row, the last as a prefix."""
    sizes, rows = piece.sizes, len(piece.sizes)
    coded = piece.rows.column("tokens").flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    names = [names[i] for i in order]
    of = dict(zip(names, range(len(names)), strict=True))
    words = rank[coded.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(rows), sizes)
    follower = np.zeros(len(words), np.int64)
    follower[:-1] = np.where(row[1:] == row[:-1], words[1:] + 1, 0)
    wide = len(names) + 1
    pairs = words * wide + follower
    by = np.argsort(pairs, kind="stable")
    pairs = pairs[by]
    bounds = np.zeros((2, len(asks.tokens)), np.int64)
    for k, q in enumerate(asks.tokens):
        low = bisect_left(names, q[-1])
        if low == len(names) or not names[low].startswith(q[-1]):
            continue
        high = bisect_left(names, q[-1] + AFTER, low)
        if len(q) == 1:
            bounds[:, k] = low * wide, high * wide
        elif all(t in of for t in q[:-1]):
            bounds[:, k] = of[q[-2]] * wide + low + 1, of[q[-2]] * wide + high + 1
    start, end = np.searchsorted(pairs, bounds)
    live = np.flatnonzero(end > start)
    part = np.cumsum(np.maximum(end[live] - start[live], rows)) // PLACES
    for some in np.split(live, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(live) else ():
        n = end[some] - start[some]
        first = np.cumsum(n) - n
        at = by[np.repeat(start[some] - first, n) + np.arange(n.sum())]
        cell = np.repeat(np.arange(len(some)) * rows, n) + row[at]
        kept = np.ones(len(cell), bool)
        for i, k in enumerate(some):
            own = slice(first[i], first[i] + n[i])
            # of longer asks, the tokens before the last two
            for back, t in enumerate(asks.tokens[k][-3::-1], 1):
                before = np.maximum(at[own] - back, 0)
                kept[own] &= (at[own] >= back) & (row[before] == row[at[own]]) & (words[before] == of[t])
        hits = np.bincount(cell[kept], minlength=len(some) * rows)
        hit = np.flatnonzero(hits)
        yield some[hit // rows], hit % rows, hits[hit]


def _scan(addresses: DataFrame, asks: DataFrame, made: Made, shape: str, *columns: str) -> DataFrame:
    """What `made` returns of the hits of asks (ask, q and more) in the texts of each task; columns: those of addresses that it reads."""
    n = int(addresses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # long texts may come in few files: every core takes some
    texts = addresses.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("part"), F.lit(1).alias("side"), "address", *columns)
    every = asks.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(n - 1))), "side": F.lit(0)})
    both = every.unionByName(texts, allowMissingColumns=True).repartitionById(n, "part").sortWithinPartitions("side")
    both = both.select("side", F.coalesce("q", text.tokens(F.col("address"))).alias("tokens"), *(c for c in asks.columns if c != "q"), *columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: list[pa.RecordBatch] = []
        later = iter(batches)
        texts = None
        for batch in later:
            k = int(np.searchsorted(batch.column("side").to_numpy(), 1))
            ahead.append(batch.slice(0, k))
            if k < batch.num_rows:
                texts = batch.slice(k)
                break
        if texts is None or not sum(b.num_rows for b in ahead):
            return
        own = _asks(ahead)

        yield from made(own, ((piece, _found(piece, own)) for batch in chain([texts], later) for piece in _pieces(batch)))

    return both.mapInArrow(task, shape)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """query_id, ask, q of queries with a token; and ask, q of each different q."""
    asked = cut(queries.select("query_id", text.tokens(F.col("query")).alias("q")).where(F.size("q") > 0))
    asks = cut(asked.select("q").distinct().withColumn("ask", F.monotonically_increasing_id()))
    return cut(asked.join(asks, "q").select("query_id", "ask", "q")), asks


def _counted(asks: Asks, pieces: Iterator[tuple[Piece, Found]]) -> Iterator[pa.RecordBatch]:
    """ask, n: the rows that an ask hits; ask is null for all tokens."""
    n, total = np.zeros(len(asks.numbers), np.int64), 0
    for piece, found in pieces:
        total += int(piece.sizes.sum())
        for k, _, _ in found:
            n += np.bincount(k, minlength=len(n))
    yield pa.RecordBatch.from_pydict({"ask": pa.array([*asks.numbers.tolist(), None], pa.int64()), "n": pa.array([*n.tolist(), total], pa.int64())})


def _weighed(addresses: DataFrame, asks: DataFrame) -> tuple[DataFrame, float]:
    """ask, idf of the asks that rows have; and the mean length of the rows."""
    counts = cut(_scan(addresses, asks, _counted, "ask long, n long").groupBy("ask").agg(F.sum("n").alias("n")))
    rows, total = addresses.count(), counts.where("ask is null").agg(F.sum("n")).first()[0]
    hit = counts.where("ask is not null and n > 0")
    return hit.select("ask", text.idf(F.lit(float(rows)), F.col("n")).alias("idf")), (total / rows if total else 1.0)


def _every(mean: float | None) -> Made:
    """query_id, id, hits of every hit of every query, and with a mean length the relevance."""

    def made(asks: Asks, pieces: Iterator[tuple[Piece, Found]]) -> Iterator[pa.RecordBatch]:
        queries = asks.rows["query_id"].combine_chunks()
        idf = None if mean is None else asks.rows["idf"].to_numpy()[asks.owners[asks.starts[:-1]]]
        many = np.diff(asks.starts)
        for piece, (k, row, n) in ((piece, hits) for piece, found in pieces for hits in found):
            ids, ends = piece.rows.column("id"), np.cumsum(many[k])
            for low in range(0, int(ends[-1]) if len(ends) else 0, OUT):
                out = np.arange(low, min(low + OUT, ends[-1]))
                hit = np.searchsorted(ends, out, "right")
                owner = asks.owners[asks.starts[k[hit]] + out - (ends[hit] - many[k[hit]])]
                columns = [queries.take(pa.array(owner)), ids.take(pa.array(row[hit])), pa.array(n[hit])]
                if mean is not None:
                    columns.append(pa.array(text.relevance(idf[k[hit]], n[hit], piece.sizes[row[hit]], mean)))
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "hits", "relevance"][: len(columns)])

    return made


def counts(addresses: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, hits: how often the row id of addresses (id, address) has the tokens of a query (query_id, query) in a row, the last as a prefix; rows without a hit are left out."""
    owners, _ = _asked(queries)
    return _scan(addresses, owners, _every(None), f"query_id {_kind(queries, 'query_id')}, id {_kind(addresses, 'id')}, hits long", "id")


def scored(addresses: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, hits, relevance: counts() with BM25, the phrase as one term."""
    owners, asks = _asked(queries)
    idf, mean = _weighed(addresses, asks)
    return _scan(addresses, cut(owners.join(idf, "ask")), _every(mean), f"query_id {_kind(queries, 'query_id')}, id {_kind(addresses, 'id')}, hits long, relevance double", "id")


def _first(ask: np.ndarray, rank: np.ndarray, relevance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each ask, by ask: of greatest rank, greatest relevance and least id."""
    by = np.lexsort((np.unique(ids, return_inverse=True)[1], -relevance, -rank, ask))
    ask = ask[by]
    return by[np.arange(len(by)) - np.searchsorted(ask, ask) < k]


def _best(mean: float, k: int, digits: int | None) -> Made:
    """ask, id, rank_score, relevance of a task's k best hits of each ask."""

    def made(asks: Asks, pieces: Iterator[tuple[Piece, Found]]) -> Iterator[pa.RecordBatch]:
        idf = asks.rows["idf"].to_numpy()[asks.owners[asks.starts[:-1]]]
        # rank and relevance of the k-th so far
        least = np.full((2, len(idf)), -np.inf)
        best, waiting = [], 0

        def ranked() -> tuple[np.ndarray, ...]:
            ask, rank, relevance, ids = (np.concatenate(c) for c in zip(*best, strict=True))
            first = _first(ask, rank, relevance, ids, k)
            ask, rank, relevance, ids = ask[first], rank[first], relevance[first], ids[first]
            last = np.flatnonzero(np.arange(len(ask)) - np.searchsorted(ask, ask) == k - 1)
            least[:, ask[last]] = rank[last], relevance[last]
            return ask, rank, relevance, ids

        for piece, (ask, row, n) in ((piece, hits) for piece, found in pieces for hits in found):
            relevance = text.relevance(idf[ask], n, piece.sizes[row], mean)
            if digits is not None:
                relevance = np.floor(relevance * 10.0**digits + 0.5) / 10.0**digits
            rank = piece.rows.column("rank_score").fill_null(-np.inf).to_numpy()[row]
            may = (rank > least[0, ask]) | (rank == least[0, ask]) & (relevance >= least[1, ask])
            best.append((ask[may], rank[may], relevance[may], piece.rows.column("id").to_numpy(zero_copy_only=False)[row[may]]))
            waiting += int(may.sum())
            if waiting > WAITING:
                best, waiting = [ranked()], 0
        if best:
            ask, rank, relevance, ids = ranked()
            yield pa.RecordBatch.from_arrays([pa.array(asks.numbers[ask]), pa.array(ids), pa.array(rank, mask=np.isneginf(rank)), pa.array(relevance)], ["ask", "id", "rank_score", "relevance"])

    return made


def best(addresses: DataFrame, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """query_id, place, id, rank_score, relevance of the k best rows of addresses (id, address, rank_score) for each query, by rank, relevance (to so many digits) and id. A task lets out no more than k rows an ask."""
    owners, asks = _asked(queries)
    idf, mean = _weighed(addresses, asks)
    ranked = addresses.withColumn("rank_score", F.col("rank_score").cast("double"))
    found = _scan(ranked, cut(asks.join(idf, "ask")), _best(mean, k, digits), f"ask long, id {_kind(addresses, 'id')}, rank_score double, relevance double", "id", "rank_score")
    place: Column = F.row_number().over(W.partitionBy("ask").orderBy(F.desc("rank_score"), F.desc("relevance"), F.asc("id")))
    first = cut(found.withColumn("place", place).where(F.col("place") <= k))
    return owners.join(first, "ask").select("query_id", "place", "id", "rank_score", "relevance")
