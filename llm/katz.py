"""Language-model scores from a Katz backoff model of ORDER words.

P(w | context) is the Good-Turing discounted share d(c) c(context w) / c(context) where the n-gram was
seen, and else alpha(context) P(w | context without its first word); P(w) is discounted alike, its
left-over mass standing for any unseen word. alpha is exactly the mass left by a context's successors
over the mass that the next lower order leaves to the others. Contexts before a text are filled up
with a begin mark. One departure from Katz's formula: counts above DISCOUNTED lose TRACE, so that
every context leaves some mass.

Counts live in tables partitioned by level and the n-gram's hash. Documents are cut into chunks of
about CHUNK tokens; a chunk asks each partition for the counts of its different n-grams and gets them
back in the order asked, so a frequent n-gram is one entry per chunk, and nothing is broadcast or
collected but the totals and the numbers of n-grams seen 1, 2, ... times. The number of partitions
grows with the tokens, so that one holds about PART_TOKENS of them at each level.

One chunk that holds an n-gram owns it, and adds it to the sums of its context. These are numbers of
n-grams by count, exact in whatever order they are added. A training token has always seen its own
n-gram, so only contexts of other documents back off: each partition tells which n-grams those hold,
and no other context's sums are sent.

Words are 64-bit hashes of lower-cased words (A-Z only). Null text counts as empty: its only token is
the end. Documents without id are scored, not learned from and not held out. Repeated rows count and
are scored each. Columns other than doc_id and text are not read. Without training rows all words are
unseen: base_score takes N = V = 0, and score gives each token the mass of the unseen, 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.groups import grouped
from llm.tables import keep
from llm.words import mix, word_hashes

ORDER = 3
CHUNK = 1_000_000
#: Counts up to this are discounted, as in Katz's paper.
DISCOUNTED = 5
#: Counts above it lose so much of one, that every context leaves some mass to words not seen after it.
TRACE = 0.05
#: Hash partitions of the counts for each shuffle partition, and the tokens that ask one at most, on average.
PARTS = 4
PART_TOKENS = 1 << 21

END, BEGIN = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0xB0E0B0E0B0E0B0E3)


def pack(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()) if len(x) else b""


def unpack(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.zeros(1, np.uint64)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


STATE = "chunk long, size long, doc_id array<long>, train binary, held binary, lengths binary, vocab binary, counts binary, tokens binary"


def _by_count(counts: np.ndarray) -> np.ndarray:
    """Places of words, the most frequent first: as such numbers tokens take the least room."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, parts, size = TaskContext.get().partitionId() << 24, [], 0

    def made():
        ids, train, held, lengths, words = (np.concatenate(x) for x in zip(*parts, strict=True))
        vocab, tokens, counts = np.unique(words, return_inverse=True, return_counts=True)
        rank = np.empty(len(vocab), np.uint32)
        rank[_by_count(counts)] = np.arange(len(vocab))
        row = [number, len(tokens), ids.tolist(), pack(train), pack(held), pack(lengths), pack_sorted(vocab), pack(counts.astype(np.uint32)), pack(rank[tokens])]
        types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["chunk", "size", "doc_id", "train", "held", "lengths", "vocab", "counts", "tokens"])

    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            words, firsts, *_ = word_hashes(batch.column(1))
            lengths = np.diff(firsts).astype(np.uint32) + 1
            ids = np.array(batch.column(0).to_pylist(), object)
            flags = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.uint8) for k in (2, 3)]
            parts.append((ids, *flags, lengths, np.insert(words, firsts[1:], END)))
            size += int(lengths.sum())
            if size >= CHUNK:
                yield made()
                number, parts, size = number + 1, [], 0
    if parts:
        yield made()


class Level:
    """A chunk's n-grams of one length: `keys` in order, `at` the place of the one that ends at each token, `end` a token that ends each."""

    def __init__(self, hashes: np.ndarray):
        self.keys, self.at = np.unique(hashes, return_inverse=True)
        self.end = np.empty(len(self.keys), np.int64)
        self.end[self.at] = np.arange(len(hashes))


class Chunk:
    """A chunk's documents and the levels 1 to `order` of its n-grams, or the last alone; `first` is the first token of each document, `learned` marks the tokens of training documents."""

    def __init__(self, row: dict, order: int, last: bool = False):
        self.number, self.ids = row["chunk"], row["doc_id"]
        self.train, self.held, self.lengths = unpack(row["train"], np.uint8).astype(bool), unpack(row["held"], np.uint8).astype(bool), unpack(row["lengths"], np.uint32).astype(np.int64)
        words = unpack_sorted(row["vocab"])[_by_count(unpack(row["counts"], np.uint32))][unpack(row["tokens"], np.uint32)]
        self.first = np.cumsum(self.lengths) - self.lengths
        self.learned = np.repeat(self.train, self.lengths)
        self.levels, hashes, self.begin = [], words, [np.array([BEGIN])]
        for k in range(1, order + 1):
            if k == order or not last:
                self.levels.append(Level(hashes))
            before = np.empty_like(hashes)
            before[1:] = hashes[:-1]
            before[self.first] = self.begin[-1]
            hashes = mix(before * np.uint64(3) + words)
            self.begin.append(mix(self.begin[-1] * np.uint64(3) + BEGIN))

    def contexts(self, k: int) -> np.ndarray:
        """For each token the place of its context among the n-grams of level index k - 1; the begin of a text is past them all."""
        out = np.empty(len(self.learned), np.int64)
        out[1:] = self.levels[k - 1].at[:-1]
        out[self.first] = len(self.levels[k - 1].keys)
        return out


def _borders(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition's share of sorted hashes begins (parts + 1 places)."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))


def _asks(state: DataFrame, parts: int, k: int) -> DataFrame:
    """What the chunks ask each partition about their n-grams of k words."""
    names = ["part", "level", "chunk", "keys", "counts", "wants"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, k, last=True)
                level = chunk.levels[-1]
                counts = np.bincount(level.at[chunk.learned], minlength=len(level.keys)).astype(np.uint32)
                wants = np.bincount(level.at[~chunk.learned], minlength=len(level.keys)) > 0
                at = _borders(level.keys, parts)
                rows = [(p, k, chunk.number, pack_sorted(level.keys[i:j]), pack(counts[i:j]), pack(np.packbits(wants[i:j]))) for p, (i, j) in enumerate(zip(at, at[1:], strict=False)) if j > i]
                types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return state.mapInArrow(run, "part int, level int, chunk long, keys binary, counts binary, wants binary")


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unpack(data, np.uint8))[:n].astype(bool)


ANSWER = "chunk long, part int, level int, totals binary, owner binary, wanted binary, numbers array<long>"


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over all chunks, to each that asked, whether it owns the n-gram, and whether a document that isn't learned from holds it.

    Chunk -1 holds the partition's numbers: n-grams seen 1 to DISCOUNTED + 1 times, different ones, and their total."""
    for group in grouped(batches, ["part", "level"]):
        part, level = group.column("part")[0].as_py(), group.column("level")[0].as_py()
        asked = [unpack_sorted(k) for k in group.column("keys").to_pylist()]
        counts = np.concatenate([unpack(c, np.uint32) for c in group.column("counts").to_pylist()])
        wants = np.concatenate([_bits(w, len(k)) for w, k in zip(group.column("wants").to_pylist(), asked, strict=True)])
        own, which = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(which, weights=counts).astype(np.int64)
        wanted = np.zeros(len(own), bool)
        wanted[which[wants]] = True
        first = np.empty(len(own), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        owner = np.zeros(len(which), bool)
        owner[first[totals > 0]] = True
        seen = totals[totals > 0]
        numbers = [int((seen == r).sum()) for r in range(1, DISCOUNTED + 2)] + [len(seen), int(seen.sum())]
        rows, at = [(-1, part, level, b"", b"", b"", numbers)], 0
        for chunk, keys in zip(group.column("chunk").to_pylist(), asked, strict=True):
            to = at + len(keys)
            rows.append((chunk, part, level, pack(totals[which[at:to]].astype(np.uint64)), pack(np.packbits(owner[at:to])), pack(np.packbits(wanted[which[at:to]])), None))
            at = to
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["chunk", "part", "level", "totals", "owner", "wanted", "numbers"])


def discounts(numbers: list[int]) -> np.ndarray:
    """d(0) to d(DISCOUNTED) from the numbers of n-grams seen 1, 2, ... times.

    Where Good-Turing gives no value between 0 and 1, as happens with few data, half a count is taken off."""
    n = np.array([0, *numbers[: DISCOUNTED + 1]], float)
    out = np.ones(DISCOUNTED + 1)
    r = np.arange(1, DISCOUNTED + 1)
    with np.errstate(all="ignore"):
        rest = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
        d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
    ok = np.isfinite(d) & (d > 0) & (d < 1)
    out[1:] = np.where(ok, d, (r - 0.5) / r)
    return out


class Model:
    """Totals of the model: what every task knows. numbers: of each level, as _answers gives them."""

    def __init__(self, numbers: dict[int, list[int]], texts: int, order: int = ORDER):
        every = [numbers.get(k, [0] * (DISCOUNTED + 3)) for k in range(1, order + 1)]
        self.order, self.texts, self.vocabulary, self.total = order, texts, every[0][-2], every[0][-1]
        self.discounts = [discounts(n) for n in every]
        one = every[0]
        left = sum((1 - self.discounts[0][r]) * r * n for r, n in enumerate(one[:DISCOUNTED], 1)) + TRACE * (self.vocabulary - sum(one[:DISCOUNTED]))
        self.unseen = left / self.total if self.total else 1.0

    def kept(self, level: int, counts: np.ndarray) -> np.ndarray:
        """Discounted counts of n-grams of `level` words."""
        return np.where(counts > DISCOUNTED, counts - TRACE, self.discounts[level - 1][np.minimum(counts, DISCOUNTED)] * counts)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """P(w) of words with these counts."""
        if not self.total:
            return np.ones(len(counts))
        return np.where(counts > 0, self.kept(1, counts) / self.total, self.unseen)

    def kept_of(self, level: int, tallies: np.ndarray) -> np.ndarray:
        """Sums of discounted counts from tallies (a row each): the numbers of n-grams seen 1, ..., DISCOUNTED times and more, and the total count of those seen more."""
        r = np.arange(1, DISCOUNTED + 1)
        return tallies @ np.concatenate((self.discounts[level - 1][1:] * r, [-TRACE, 1.0]))


TALLY = DISCOUNTED + 2


def tallies(rows: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Tallies of the counts by row (n rows), as Model.kept_of takes them."""
    column = np.minimum(counts, DISCOUNTED + 1) - 1
    out = np.bincount(rows * TALLY + column, minlength=n * TALLY)
    more = counts > DISCOUNTED
    np.add.at(out, rows[more] * TALLY + TALLY - 1, counts[more])
    return out.reshape(n, TALLY)


SUMS = ["keys", "context", "lower", "left", "mass", "need"]
PARTIAL = "kind int, level int, part int, chunk long, keys binary, context binary, lower binary, left binary, mass binary, need binary, doc_id array<long>, held array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>, rest binary, texts binary"
_PARTIAL_TYPES = pa.schema(
    [("kind", pa.int32()), ("level", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), *((n, pa.binary()) for n in SUMS), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("score", pa.list_(pa.float64())), ("rest", pa.binary()), ("texts", pa.binary())]
)


def _score_chunk(state: pa.Table, answers: pa.Table, model: Model, parts: int) -> pa.Table:
    """kind 0: the chunk's documents, with the tokens whose backoff weights are still open; kind 1: a partition's share of the contexts' sums, by level."""
    if not state.num_rows:
        return _PARTIAL_TYPES.empty_table()
    chunk = Chunk(state.to_pylist()[0], model.order)
    totals, owner, wanted = ([[] for _ in chunk.levels] for _ in range(3))
    for row in sorted(answers.to_pylist(), key=lambda r: (r["level"], r["part"])):
        k = row["level"] - 1
        totals[k].append(unpack(row["totals"], np.uint64).astype(np.int64))
        owner[k].append(_bits(row["owner"], len(totals[k][-1])))
        wanted[k].append(_bits(row["wanted"], len(totals[k][-1])))
    totals, owner, wanted = ([np.concatenate(x) for x in part] for part in (totals, owner, wanted))
    number = np.repeat(np.arange(len(chunk.lengths)), chunk.lengths)
    add = lambda x: np.add.reduceat(x, chunk.first)

    c1 = totals[0][chunk.levels[0].at]
    base = add(np.log10((c1 + 1) / (model.total + model.vocabulary + 1)))
    # from the lowest level up: an n-gram that was seen replaces what lower levels gave
    p, out, rest, texts, sent = model.unigram(c1), [], [], [], 0
    open_levels = []
    for k in range(1, model.order):
        level, before = chunk.levels[k], chunk.contexts(k)
        context = np.append(totals[k - 1], model.texts)
        count, of = totals[k][level.at], context[before]
        seen = count > 0
        p = np.where(seen, model.kept(k + 1, count) / np.maximum(of, 1), p)
        open_levels = [o & ~seen for o in open_levels] + [~seen & (of > 0)]
    score = add(np.log10(p))

    for k, still in enumerate(open_levels, 1):
        level, before, below = chunk.levels[k], chunk.contexts(k), chunk.levels[k - 1]
        size = len(below.keys) + 1
        context = np.append(totals[k - 1], model.texts)
        need = np.zeros(size, bool)
        need[before[still]] = True
        # what the n-grams this chunk owns take of both distributions, for contexts that others need
        own = np.flatnonzero(owner[k] & np.append(wanted[k - 1], True)[before[level.end]])
        of, counts, lower = before[level.end[own]], totals[k][own], totals[k - 1][below.at[level.end[own]]]
        used = need.copy()
        used[of] = True
        used = np.flatnonzero(used)
        keys = np.append(below.keys, chunk.begin[k - 1])[used]
        order = np.argsort(keys)
        used, keys = used[order], keys[order]
        place = np.full(size, -1)
        place[used] = np.arange(len(used))
        left, mass = (tallies(place[of], c, len(used)) for c in (counts, lower))
        if k > 1:
            lower = np.append(totals[k - 2][chunk.levels[k - 2].at[below.end]], model.texts)[used]
        else:
            lower = np.full(len(used), model.total)
        at = _borders(keys, parts)
        for part, (i, j) in enumerate(zip(at, at[1:], strict=False)):
            if j > i:
                numbers = (context[used[i:j]], lower[i:j], left[i:j].T.ravel(), mass[i:j].T.ravel())
                columns = (pack_sorted(keys[i:j]), *(pack(x.astype(np.uint64)) for x in numbers), pack(np.packbits(need[used[i:j]])))
                out.append({"kind": 1, "level": k + 1, "part": part, "chunk": chunk.number, **dict(zip(SUMS, columns, strict=True))})
        # open tokens name their context by its place among those sent that are needed, of all levels
        needed = used[need[used]]
        place[needed] = sent + np.arange(len(needed))
        sent += len(needed)
        rest.append(place[before[still]])
        texts.append(number[still])
    both = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.uint32) for x in (rest, texts))
    out.append(
        {"kind": 0, "chunk": chunk.number, "doc_id": chunk.ids, "held": chunk.held.tolist(), "n_tokens": chunk.lengths.tolist(), "n_known": add((c1 > 0).astype(np.int64)).tolist(), "base": base.tolist(), "score": score.tolist(), **dict(zip(("rest", "texts"), map(pack, both), strict=True))}
    )
    return pa.Table.from_pylist(out, _PARTIAL_TYPES)


def _weights(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """log10 alpha of the contexts that chunks need, in the order sent."""
    for group in grouped(batches, ["part", "level"]):
        rows = group.to_pylist()
        keys = [unpack_sorted(r["keys"]) for r in rows]
        own, which = np.unique(np.concatenate(keys), return_inverse=True)
        # each chunk that names a context knows its counts
        context, lower = np.zeros(len(own)), np.zeros(len(own))
        left, mass = np.zeros((len(own), TALLY)), np.zeros((len(own), TALLY))
        at = 0
        for r, k in zip(rows, keys, strict=True):
            here = which[at : at + len(k)]
            context[here], lower[here] = unpack(r["context"], np.uint64), unpack(r["lower"], np.uint64)
            left[here] += unpack(r["left"], np.uint64).reshape(TALLY, -1).T
            mass[here] += unpack(r["mass"], np.uint64).reshape(TALLY, -1).T
            at += len(k)
        level = rows[0]["level"]
        context, lower = np.maximum(context, 1), np.maximum(lower, 1)
        alpha = np.maximum(1 - model.kept_of(level, left) / context, 1e-12) / np.maximum(1 - model.kept_of(level - 1, mass) / lower, 1e-12)
        out, at = [], 0
        for r, k in zip(rows, keys, strict=True):
            need = _bits(r["need"], len(k))
            if need.any():
                out.append((r["chunk"], r["part"], level, pack(np.log10(alpha[which[at : at + len(k)]][need]))))
            at += len(k)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["chunk", "part", "level", "weights"])


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """RESULT for every row: a model of n-grams of up to `order` words, trained on the rows whose crc32(doc_id as text) mod 7 is not 2, which are held out."""
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(fold != 2, F.lit(False)).alias("train"), F.coalesce(fold == 2, F.lit(False)).alias("held"))
    state = keep(rows.mapInArrow(_chunks, STATE), "katz-state")
    tokens = state.agg(F.sum("size")).first()[0] or 0
    parts = max(PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PART_TOKENS))
    answers = None
    for k in range(1, order + 1):
        # a level at a time, so that only one level's questions are on disk
        asks = _asks(state, parts, k).repartition("part").sortWithinPartitions("part", "level", "chunk")
        level = keep(asks.mapInArrow(_answers, ANSWER), f"katz-answers-{k}")
        answers = level if answers is None else answers.union(level)
    sums = answers.where("chunk < 0").groupBy("level").agg(*(F.sum(F.col("numbers")[i]).alias(f"n{i}") for i in range(DISCOUNTED + 3))).collect()
    texts = rows.select("train").where("train").count()
    model = Model({r["level"]: [int(r[f"n{i}"]) for i in range(DISCOUNTED + 3)] for r in sums}, texts, order)
    both = state.groupBy("chunk").cogroup(answers.where("chunk >= 0").select("chunk", "part", "level", "totals", "owner", "wanted").groupBy("chunk"))
    partial = keep(both.applyInArrow(lambda a, b: _score_chunk(a, b, model, parts), PARTIAL), "katz-partial")
    asked = partial.where("kind = 1").select("part", "level", "chunk", *SUMS)
    asked = asked.repartition("part", "level").sortWithinPartitions("part", "level", "chunk")
    weights = asked.mapInArrow(lambda b: _weights(b, model), "chunk long, part int, level int, weights binary")
    total = model.total

    def finish(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        if not a.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        row = a.to_pylist()[0]
        score = np.array(row["score"])
        found = [unpack(r["weights"], np.float64) for r in sorted(b.to_pylist(), key=lambda r: (r["level"], r["part"]))]
        if found:
            alpha = np.concatenate(found)[unpack(row["rest"], np.uint32)]
            score = score + np.bincount(unpack(row["texts"], np.uint32), weights=alpha, minlength=len(score))
        columns = (row["doc_id"], row["held"], row["n_tokens"], row["n_known"], [total] * len(score), row["base"], score)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    kept = partial.where("kind = 0").select("chunk", "doc_id", "held", "n_tokens", "n_known", "base", "score", "rest", "texts")
    return kept.groupBy("chunk").cogroup(weights.groupBy("chunk")).applyInArrow(finish, RESULT)
