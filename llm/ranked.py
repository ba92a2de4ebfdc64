"""Ranked lexical search over dual-sorted wavelet trees, one a shard (Navarro and Puglisi, "Dual-sorted inverted lists").

A shard holds the documents that one task reads in a row, up to DOCS of them and TOKENS terms. Its lists
of postings, each by falling impact, stand behind each other as one sequence of documents, numbered by
doc_id. A wavelet tree over that sequence (a wavelet matrix: a row of bits a level) splits the documents
in halves, level by level, and keeps within each node the order by impact. So the first posting of a
list in a node is its best there, and the sum of those over the query's terms bounds every document of
the node. Nodes are looked at best first, a few at a time; those whose bound can't beat the k-th best
document found are left; a leaf's bound is its document's score. The k best are exact.

Shards are rows of a written table. Queries meet them in blocks of BLOCK items by a join on the block's
number; Spark broadcasts the blocks while their size, which it checks, allows. A task remembers the k-th
best score of an item over its shards. What is shuffled is k rows an item and task at most, and the
counts of the queries' terms.

Null texts have no terms. Each row is a document, repeated rows too; rows with a null doc_id come last
among equal scores. An item is a distinct pair of item_id and text. Equal terms are told apart within a
shard by 64 bits, across shards by their text. Other columns aren't read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.licenses import LOWER, UPPER
from llm.tables import keep
from llm.words import column_bytes, word_hashes, word_spans

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of terms, A-Z as a-z; all others part terms.
_BYTES = np.full(256, 0x20, np.uint8)
_BYTES[0x30:0x3A] = np.arange(0x30, 0x3A)
_BYTES[0x61:0x7B] = _BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
_BYTES[0x80:] = np.arange(0x80, 0x100)
#: Fixed by the contract: the impact of tf occurrences in a text of relative length m is SCALE * tf div (1000 * tf + 20 * m), m in hundredths, half of it by length.
SCALE = 1_000_000_000
TOP = 50
DOCS, TOKENS = 16384, 2_000_000
BLOCK = 256
#: Bytes of text that are cut to terms at once, of however many rows; a text isn't parted.
PIECE = 2 * TOKENS
#: Nodes looked at together.
BEST = 96
SHARD = "doc_ids array<bigint>, terms array<string>, counts array<int>, impacts binary, bits binary"
FOUND = "item_id {}, key string, doc_id long, score long"
LAST = np.iinfo(np.int64).max


class Index(NamedTuple):
    shards: DataFrame
    documents: int
    terms: int


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all terms, each text's first term, the terms' first and past-the-end bytes, and the bytes."""
    data, offsets = column_bytes(column)
    data = _BYTES[data]
    plain = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)])
    hashes, firsts, starts, ends, _ = word_hashes(plain)
    return hashes, firsts, starts, ends, data


def _rows_within(column: pa.Array, at: int) -> int:
    """How many texts from `at` on have PIECE bytes together; one at least."""
    size = pc.fill_null(pc.binary_length(column.slice(at)), 0).to_numpy(zero_copy_only=False)
    return max(1, int(np.searchsorted(np.cumsum(size, dtype=np.int64), PIECE, "right")))


def counted(column: pa.Array) -> tuple[int, int]:
    """Texts with a term, and all their terms, a piece at a time."""
    some = terms = at = 0
    while at < len(column):
        rows = _rows_within(column, at)
        data, offsets = column_bytes(column.slice(at, rows))
        n = np.diff(np.searchsorted(word_spans(_BYTES[data], offsets)[0], offsets))
        some, terms, at = some + int((n > 0).sum()), terms + int(n.sum()), at + rows
    return some, terms


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = terms = 0
        for batch in batches:
            n = counted(batch.column(0))
            some, terms = some + n[0], terms + n[1]
        yield pa.RecordBatch.from_pydict({"some": [some], "terms": [terms]})

    row = docs.select(F.col("text").cast("string")).mapInArrow(count, "some long, terms long").agg(F.sum("some"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (1000 * tf + 20 * m)


def levels_of(docs: int) -> int:
    return max(1, (docs - 1).bit_length())


def _shard(ids: list, hashes: np.ndarray, counts: np.ndarray, spelt: dict[str, np.ndarray], documents: int, terms: int) -> pa.RecordBatch:
    """One shard: counts are the terms of each document in turn."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    m = np.array([50 + 50 * int(counts[i]) * documents // terms for i in order], np.int64)
    kinds, first, term = np.unique(hashes, return_index=True, return_inverse=True)
    pairs, tf = np.unique(term * len(ids) + np.repeat(number, counts), return_counts=True)
    term, doc = pairs // len(ids), pairs % len(ids)
    value = impact(tf.astype(np.int64), m[doc])
    by = np.lexsort((doc, -value, term))
    term, doc, value = term[by], doc[by], value[by]
    bits, at = [], doc
    for level in reversed(range(levels_of(len(ids)))):
        one = (at >> level & 1).astype(bool)
        bits.append(np.packbits(one))
        at = np.concatenate((at[~one], at[one]))
    begin, length = spelt["starts"][first], spelt["ends"][first] - spelt["starts"][first]
    offsets = np.concatenate(([0], np.cumsum(length)))
    letters = spelt["bytes"][np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])]
    names = pa.Array.from_buffers(pa.large_string(), len(kinds), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))]).cast(pa.string())
    one_list = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays(
        [
            one_list(pa.array([ids[i] for i in order], pa.int64())),
            one_list(names),
            one_list(pa.array(np.bincount(term, minlength=len(kinds)).astype(np.int32))),
            pa.array([value.astype(np.int32).tobytes()], pa.binary()),
            pa.array([np.concatenate(bits).tobytes()], pa.binary()),
        ],
        ["doc_ids", "terms", "counts", "impacts", "bits"],
    )


def build(docs: DataFrame) -> Index:
    """The index of doc_id and text of all rows that hold a term."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    documents, terms = totals(slim)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0

        def flush():
            move = np.cumsum([0] + [len(p[4]) for p in parts])
            spelt = {"starts": np.concatenate([p[2] + k for p, k in zip(parts, move, strict=False)]), "ends": np.concatenate([p[3] + k for p, k in zip(parts, move, strict=False)]), "bytes": np.concatenate([p[4] for p in parts])}
            return _shard(ids, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), spelt, documents, terms)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                n = min(_rows_within(batch.column(1), at), DOCS - len(ids))  # a term has two bytes at least, with what parts it
                piece = batch.slice(at, n)
                hashes, firsts, starts, ends, data = _terms(piece.column(1))
                counts = np.diff(firsts)
                some = counts > 0
                if held + len(hashes) > TOKENS and ids:
                    yield flush()
                    ids, parts, held = [], [], 0
                ids += [i for i, s in zip(piece.column(0).to_pylist(), some, strict=True) if s]
                parts.append((hashes, counts[some], starts, ends, data))
                held += len(hashes)
                at += n
                if len(ids) >= DOCS:
                    yield flush()
                    ids, parts, held = [], [], 0
        if ids:
            yield flush()

    return Index(keep(slim.mapInArrow(shards, SHARD), "ranked-shards", "zstd"), documents, terms)


class Tree:
    """A shard's wavelet tree in memory: zeros before each place of each level, and impacts in each level's order."""

    def __init__(self, doc_ids: pa.Array, counts: np.ndarray, impacts: np.ndarray, bits: np.ndarray):
        self.docs = pc.fill_null(doc_ids, LAST).to_numpy(zero_copy_only=False)
        self.null = pc.is_null(doc_ids).to_numpy(zero_copy_only=False)
        self.starts = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        self.levels, n = levels_of(len(self.docs)), len(impacts)
        packed = bits.reshape(self.levels, -1)
        self.zeros = np.zeros((self.levels, n + 1), np.int32)
        self.impacts = np.zeros((self.levels + 1, n + 1), np.int32)
        self.impacts[0, :n] = impacts
        for level in range(self.levels):
            one = np.unpackbits(packed[level], count=n).astype(bool)
            np.cumsum(~one, out=self.zeros[level, 1:])
            row = self.impacts[level, :n]
            self.impacts[level + 1, :n] = np.concatenate((row[~one], row[one]))

    def best(self, lists: np.ndarray, weights: np.ndarray, k: int, worst: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of this shard's k best documents that beat `worst` (score, doc_id), best first; equal scores by doc_id."""
        level, node = np.zeros(1, np.int64), np.zeros(1, np.int64)
        lo, hi = self.starts[lists][None, :], self.starts[lists + 1][None, :]
        bound = (weights * self.impacts[0, lo[0]]).sum()[None]
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(bound):
            least = self.docs[node << (self.levels - level)]
            alive = (bound > worst[0]) | ((bound == worst[0]) & (least <= worst[1]))
            if not alive.all():
                level, node, lo, hi, bound = level[alive], node[alive], lo[alive], hi[alive], bound[alive]
                if not len(bound):
                    break
            pick = np.argpartition(-bound, BEST)[:BEST] if len(bound) > BEST else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[pick] = False
            leaf = pick[level[pick] == self.levels]
            if len(leaf):
                found, scores = np.concatenate((found, node[leaf])), np.concatenate((scores, bound[leaf]))
                order = np.lexsort((found, self.docs[found], -scores))[:k]
                found, scores = found[order], scores[order]
                if len(found) == k:
                    worst = max(worst, (int(scores[-1]), int(self.docs[found[-1]])), key=lambda w: (w[0], -w[1]))
            inner = pick[level[pick] < self.levels]
            at, a, b = level[inner], lo[inner], hi[inner]
            row = at[:, None]
            a0, b0, zeros = self.zeros[row, a], self.zeros[row, b], self.zeros[at, -1][:, None]
            kids_lo, kids_hi = np.concatenate((a0, zeros + a - a0)), np.concatenate((b0, zeros + b - b0))
            kids_level = np.concatenate((at, at)) + 1
            value = np.where(kids_hi > kids_lo, self.impacts[kids_level[:, None], kids_lo], 0)
            kids = (value * weights).sum(axis=1)
            some = kids > 0
            level = np.concatenate((level[rest], kids_level[some]))
            node = np.concatenate((node[rest], np.concatenate((2 * node[inner], 2 * node[inner] + 1))[some]))
            lo, hi = np.concatenate((lo[rest], kids_lo[some])), np.concatenate((hi[rest], kids_hi[some]))
            bound = np.concatenate((bound[rest], kids[some]))
        return found, scores


def searched(items: DataFrame) -> DataFrame:
    """item_id, key and terms (distinct) of every distinct item."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    terms = F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)))
    return items.select("item_id", F.md5(text.cast("binary")).alias("key"), terms.alias("terms")).dropDuplicates(["item_id", "key"])


def weighed(index: Index, items: DataFrame) -> DataFrame:
    """Blocks of items: block, items (item_id, key, terms, weights), with the terms that have postings and weight."""
    asked = keep(items.select("item_id", "key", F.explode("terms").alias("term")), "ranked-asked")
    lists = index.shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("l")).select(F.col("l.terms").alias("term"), F.col("l.counts").cast("long").alias("n"))
    df = lists.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * index.documents + 2)) / (2 * F.col("df") + 1))).cast("long")
    rows = asked.join(df, "term").withColumn("weight", weight).where("weight > 0")
    rows = rows.groupBy("item_id", "key").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("t"))
    rows = keep(rows.select("item_id", "key", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), "ranked-items")
    blocks = max(1, -(-rows.count() // BLOCK))
    block = F.pmod(F.xxhash64("item_id", "key"), F.lit(blocks)).cast("int")
    packed = keep(rows.groupBy(block.alias("block")).agg(F.collect_list(F.struct("item_id", "key", "terms", "weights")).alias("items")), "ranked-blocks")
    return packed, blocks


def search(index: Index, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, key, rank, doc_id, score: the k best documents with a score above 0 of every item (item_id, text)."""
    packed, blocks = weighed(index, searched(items))
    kind = items.schema["item_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worst: dict[int, list] = {}
        asked: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda name: batch.column(name)[i]  # noqa: B023, E731
                block = value("block").as_py()
                if block not in asked:
                    if len(asked) >= 64:  # what is forgotten only costs time
                        asked.clear(), worst.clear()
                    asked[block] = value("items").as_py()
                    worst[block] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked[block])
                binary = lambda name, kind: np.frombuffer(value(name).as_buffer(), kind)
                tree = Tree(value("doc_ids").values, value("counts").values.to_numpy(), binary("impacts", np.int32), binary("bits", np.uint8))
                every = pa.array(sorted({t for item in asked[block] for t in item["terms"]}), pa.string())
                place = dict(zip(every.to_pylist(), pc.index_in(every, value_set=value("terms").values).to_pylist(), strict=True))
                out: dict[str, list] = {"item_id": [], "key": [], "doc_id": [], "score": []}
                for q, item in enumerate(asked[block]):
                    held = [(place[t], w) for t, w in zip(item["terms"], item["weights"], strict=True) if place[t] is not None]
                    if not held:
                        continue
                    scores, docs = worst[block][q]
                    last = (int(scores[-1]), int(docs[-1])) if len(scores) == k else (0, -1)
                    at, got = tree.best(*np.array(held, np.int64).T, k, last)
                    if not len(at):
                        continue
                    out["item_id"] += [item["item_id"]] * len(at)
                    out["key"] += [item["key"]] * len(at)
                    out["doc_id"] += [None if tree.null[x] else int(tree.docs[x]) for x in at]
                    out["score"] += got.tolist()
                    scores, docs = np.concatenate((scores, got)), np.concatenate((docs, tree.docs[at]))
                    order = np.lexsort((docs, -scores))[:k]
                    worst[block][q] = (scores[order], docs[order])
                yield pa.RecordBatch.from_arrays([pa.array(out["item_id"], batch.schema.field("items").type.value_type.field("item_id").type), pa.array(out["key"], pa.string()), pa.array(out["doc_id"], pa.int64()), pa.array(out["score"], pa.int64())], list(out))

    met = index.shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "block")
    found = met.mapInArrow(find, FOUND.format(kind))
    rank = F.row_number().over(W.partitionBy("item_id", "key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "key", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score."""
    return search(build(docs), items).select("item_id", "rank", "doc_id", "score")


RANK_SQL = rf"""
WITH words AS MATERIALIZED (SELECT rid, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS t
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
docs AS MATERIALIZED (SELECT rid, doc_id, count(*) AS n FROM words GROUP BY rid, doc_id),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
posted AS MATERIALIZED (SELECT rid, t, count(*) AS tf FROM words GROUP BY rid, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM posted, total GROUP BY t, n_docs),
asked AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS t FROM benchmark),
scored AS (SELECT item_id, text, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (t) JOIN posted USING (t) JOIN docs USING (rid), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored JOIN docs USING (rid) WHERE score > 0 QUALIFY rank <= 50
"""
