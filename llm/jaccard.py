"""N-gram Jaccard join by chosen paths (Christiani, Pagh and Sivertsen, "Scalable and robust set similarity join").

A document is the set of its runs of WIDTH words, described by COORDINATES minimum hashes. In each
of some independent runs, every set follows the paths that shared randomness chooses: at a node one
or two coordinates are sampled (1 / SIMILAR on average), and the set goes on to the child of each
one's value. Sets that are connected already carry one label: no edge is written between them, and a
bucket of one label has nothing left to find. A bucket in which SMALL sets or fewer are outside its
commonest label is finished by brute force: each of those is compared with all of the bucket. In a
larger one each set is compared with one pivot, and those not almost equal to it go one level down.

Where a bucket has up to LOCAL sets, one task follows all its paths to their ends. Larger buckets are
dealt out in parts of about PART sets, each with what all others are compared with, and their children
shuffled for the next level; what is still larger at the last of DEPTH levels is compared in pairs of
blocks, all by all. Sets that look similar are joined into candidate groups, in which exact
similarities are then computed in pairs of blocks of BLOCK sets and BLOCK_RUNS runs at most (a set of
more runs is a block by itself). So no task holds an unbounded group, and only counts and spanning
edges leave it. Equal sets are one set with a number of copies throughout.

RUNS runs at a time are made until those of the latest round have newly joined at most 1 - RECALL of
the pairs that look as similar as SIMILAR, by which groups are spanned. A round that finds half of the
pairs or more leaves no more behind than it newly found: then RECALL of them is reached.

Results: a row per document row, with the class (connected by similarities of SIMILAR or more; its
id is the least doc_id) and the number of other documents linked directly, copies included. A text
of fewer than WIDTH words is a set of one run, all of them; null and empty texts link to nothing and
are classes of their own. Repeated rows are copies of each other. Null doc_ids stay null and don't
name a class unless it has no other. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.groups import Forest, components, grouped, spanning
from llm.tables import free, keep
from llm.words import mix, shingles, word_hashes

WIDTH = 5
SIMILAR = 0.8
COORDINATES = 64
RUNS = 8
RECALL = 0.99
SMALL = 200
LOCAL = 8192
PART = 1000
BLOCK = 512
BLOCK_RUNS = 1 << 20
DEPTH = 12
#: Levels that a task follows before it compares all by all; the paths of different sets part long before.
DEEPEST = 64
#: Salts of the join of a bucket's sets with its size.
SALTS = 8
#: Estimates from COORDINATES values are off by up to 0.17 (three deviations): these bounds leave room for that.
LOOKS_SIMILAR = 0.62
NEAR_PIVOT = 0.55
SAME_AS_PIVOT = 0.92

_rng = np.random.default_rng(9)
_MULTIPLY = (_rng.integers(0, 2**31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)[:, None]


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of each of COORDINATES hashes over a set of 64-bit hashes."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = None
    for at in range(0, len(low), 1 << 14):
        part = (low[at : at + (1 << 14)] * _MULTIPLY + _ADD).min(axis=1)
        out = part if out is None else np.minimum(out, part)
    return out


def fingerprint(hashes: np.ndarray) -> bytes:
    """128 bits that name a set of distinct hashes."""
    other = mix(hashes + np.uint64(0x51ED))
    return np.array([hashes.sum(dtype=np.uint64), other.sum(dtype=np.uint64)], "<u8").tobytes()


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Place in the batch, and distinct run hashes in order, of each text that has words."""
    words, firsts, *_ = word_hashes(batch.column(1))
    runs, to = shingles(words, firsts, WIDTH)
    for i in range(batch.num_rows):
        if to[i + 1] > to[i]:
            yield i, np.unique(runs[to[i] : to[i + 1]])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, f (the set's fingerprint; null without words), n (runs), sig (minimum hashes), copy (MD5 of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                f: list[bytes | None] = [None] * batch.num_rows
                n, sig = [0] * batch.num_rows, [b""] * batch.num_rows
                for i, own in _sets(batch):
                    f[i], n[i], sig[i] = fingerprint(own), len(own), minima(own).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), batch.column(2)], ["doc_id", "f", "n", "sig", "copy"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _copy().alias("copy")).mapInArrow(run, "doc_id long, f binary, n long, sig binary, copy string")


def _copy() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def _children(keys: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of the children that sets at the nodes `keys` go to."""
    rows, out = [], []
    first = (mix(keys + np.uint64(1)) % np.uint64(COORDINATES)).astype(np.int64)
    second = (mix(keys + np.uint64(2)) % np.uint64(COORDINATES)).astype(np.int64)
    # one coordinate always, another so often that their number is 1 / SIMILAR on average
    also = (mix(keys + np.uint64(3)) < np.uint64(int((1 / SIMILAR - 1) * 2**64))) & (first != second)
    every = np.arange(len(keys))
    for at, own in ((first, every), (second, every[also])):
        value = sigs[own, at[own]].astype(np.uint64)
        rows.append(own)
        out.append(mix(mix(keys[own] ^ (at[own].astype(np.uint64) + np.uint64(1))) + value))
    return np.concatenate(rows), np.concatenate(out)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _roots(sets: DataFrame, runs: int, done: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = _matrix(batch.column(1))
            for r in range(done, done + runs):
                rows, keys = _children(np.full(len(sigs), mix(np.array([r + 1], np.uint64))[0]), sigs)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0).take(pa.array(rows))], ["key", "f"])

    return sets.select("f", "sig").mapInArrow(run, "key long, f binary")


def _follow(key: int, sigs: np.ndarray, which: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
    """Edges between the sets of a bucket, followed down all its paths; `forest` joins their labels, `which` of each set."""
    edges, todo = [], [(np.uint64(key), np.arange(len(sigs)), 0)]

    def join(i: int, others: np.ndarray) -> None:
        edges.extend((i, int(j)) for j in others if forest.join(int(which[i]), int(which[j])))

    while todo:
        key, own, depth = todo.pop()
        labels, place = np.unique(which[own], return_inverse=True)
        roots = np.array([forest.find(int(k)) for k in labels])[place]
        names, counts = np.unique(roots, return_counts=True)
        minor = own[roots != names[counts.argmax()]]
        if len(minor) <= SMALL or depth == DEEPEST:
            for i in minor.tolist():
                like = (sigs[own] == sigs[i]).mean(axis=1)
                near = np.flatnonzero(like >= LOOKS_SIMILAR)
                join(i, own[near[np.argsort(-like[near], kind="stable")]])
            continue
        pivot = int(own[int(mix(np.array([key], np.uint64))[0] % np.uint64(len(own)))])
        like = (sigs[own] == sigs[pivot]).mean(axis=1)
        join(pivot, own[like >= NEAR_PIVOT])
        rest = own[like < SAME_AS_PIVOT]
        rows, keys = _children(np.full(len(rest), key, np.uint64), sigs[rest])
        order = np.argsort(keys, kind="stable")
        rows, keys = rest[rows[order]], keys[order]
        first = np.flatnonzero(np.insert(keys[1:] != keys[:-1], 0, True))
        todo += [(keys[i], rows[i:j], depth + 1) for i, j in zip(first, [*first[1:], len(keys)], strict=True) if j - i > 1]
    return edges


def _compare(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Buckets or their parts to edges (g set) and to rows of the next level (key set)."""
    types = (pa.int64(), pa.binary(), pa.binary(), pa.int64())
    for group in grouped(batches, ["key", "part"]):
        f, sigs, labels = group.column("f").to_pylist(), _matrix(group.column("sig")), group.column("label").to_numpy().copy()
        # of edges between the same labels one is enough
        known, which = np.unique(labels, return_inverse=True)
        if group.column("local")[0].as_py():
            edges = _follow(int(np.int64(group.column("key")[0].as_py()).view(np.uint64)), sigs, which, Forest(len(known)))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*[(None, f[i], f[j], None) for i, j in edges], strict=True), types, strict=True)], ["key", "f", "g", "label"])
            continue
        edges: list[tuple[float, int, int]] = []
        down = np.zeros(len(f), bool)
        minor = np.flatnonzero(group.column("minor").to_numpy(zero_copy_only=False))
        few = group.column("minors")[0].as_py() <= SMALL
        if few or last:
            for i in minor if few else range(len(f)):
                like = (sigs == sigs[i]).mean(axis=1)
                near = np.flatnonzero((like >= LOOKS_SIMILAR) & (which != which[i]))
                near = near[np.argsort(-like[near], kind="stable")]
                near = near[np.sort(np.unique(which[near], return_index=True)[1])]
                edges += [(float(like[j]), int(i), int(j)) for j in near]
        else:
            pivot = int(np.argmax(group.column("is_pivot").to_numpy(zero_copy_only=False)))
            like = (sigs == sigs[pivot]).mean(axis=1)
            edges = [(float(like[i]), pivot, int(i)) for i in np.flatnonzero(like >= NEAR_PIVOT) if i != pivot]
            down = like < SAME_AS_PIVOT
        forest = Forest(len(known))
        edges = [(i, j) for _, i, j in sorted(edges, key=lambda e: -e[0]) if forest.join(int(which[i]), int(which[j]))]
        own = np.flatnonzero(down)
        rows, new = _children(np.full(len(own), group.column("key")[0].as_py(), np.int64).view(np.uint64), sigs[own])
        label = [int(known[forest.find(int(which[own[i]]))]) for i in rows]
        both = [(None, f[i], f[j], None) for i, j in edges] + [(k, f[own[i]], None, x) for i, k, x in zip(rows, new.view(np.int64).tolist(), label, strict=True)]
        if both:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*both, strict=True), types, strict=True)], ["key", "f", "g", "label"])


def candidate_edges(sets: DataFrame, runs: int = RUNS, done: int = 0, groups: DataFrame | None = None) -> DataFrame:
    """Pairs a, b of fingerprints that look similar; enough of them to connect each candidate group, besides what `groups` (node, component), of `done` runs, connects."""
    rows, first = _roots(sets, runs, done), F.col("f")
    if groups is not None:
        rows, first = rows.join(groups.withColumnRenamed("node", "f"), "f", "left"), F.coalesce("component", "f")
    # a set's first label is its own or its group's
    found, rows = None, keep(rows.select("key", "f", F.xxhash64(first).alias("label")), "jaccard-r")
    for level in range(DEPTH):
        head = F.xxhash64("f", "key")
        rows = rows.withColumn("h", head)
        by_label = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.min("h").alias("h"))
        sizes = by_label.groupBy("key").agg(F.sum("n").alias("size"), F.max_by("label", "n").alias("major"), F.max("n").alias("majors"), F.min("h").alias("pivot"), F.count("*").alias("labels"))
        sizes = sizes.where("labels > 1").select("key", "size", "pivot", "major", (F.col("size") - F.col("majors")).alias("minors"))
        parts = F.ceil(F.col("size") / PART)
        # a bucket may hold a third of all sets
        salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("local", F.col("size") <= LOCAL)
        placed = rows.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")
        placed = placed.withColumns({"is_pivot": F.col("h") == F.col("pivot"), "minor": F.col("label") != F.col("major")})
        # what is compared with all others is in every part of a bucket
        everywhere = F.when(F.col("minors") <= SMALL, F.col("minor")).otherwise(F.col("is_pivot"))
        last, every = level == DEPTH - 1, F.sequence(F.lit(0).cast("long"), parts - 1)
        block = F.pmod(F.xxhash64("h"), parts)
        own = F.when(everywhere, every).otherwise(F.array(block))
        if last:
            # nothing goes further down: blocks of what is left meet in pairs
            pairs = F.transform(every, lambda k: F.least(block, k) * parts + F.greatest(block, k))  # noqa: B023
            own = F.when(F.col("minors") <= SMALL, own).otherwise(pairs)
        own = F.when(F.col("local"), F.array(F.lit(0).cast("long"))).otherwise(own)
        placed = placed.withColumn("part", F.explode(own)).drop("h", "pivot", "major", "size")
        out = placed.join(sets.select("f", "sig"), "f").repartition("key", "part").sortWithinPartitions("key", "part")
        out = keep(out.mapInArrow(lambda b, last=last: _compare(b, last), "key long, f binary, g binary, label long"), f"jaccard-{level}")
        edges = out.where("g is not null").select(F.col("f").alias("a"), F.col("g").alias("b"))
        found = edges if found is None else found.union(edges)
        rows = out.where("key is not null").groupBy("key", "f").agg(F.min("label").alias("label"))
        if rows.first() is None:
            break
    return found


def _alike(edges: DataFrame, sets: DataFrame) -> int:
    """How many of the edges look as similar as SIMILAR."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                like = (_matrix(batch.column(0)) == _matrix(batch.column(1))).mean(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([int((like >= SIMILAR).sum())], pa.int64())], ["n"])

    sigs = sets.select("f", "sig")
    both = edges.join(sigs.withColumnsRenamed({"f": "a", "sig": "s"}), "a").join(sigs.withColumnsRenamed({"f": "b", "sig": "t"}), "b")
    return both.select("s", "t").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def candidate_groups(sets: DataFrame, runs: int = RUNS, recall: float = RECALL) -> DataFrame:
    """node, component of the sets that look similar; rounds of `runs` runs until the latest joined no more than 1 - recall of the pairs."""
    edges, groups, found, done = None, None, 0, 0
    while True:
        more = candidate_edges(sets, runs, done, groups).distinct()
        if groups is not None:
            names = groups.select(F.col("node").alias("f"), "component")
            more = more.join(names.withColumnsRenamed({"f": "a", "component": "ca"}), "a", "left").join(names.withColumnsRenamed({"f": "b", "component": "cb"}), "b", "left")
            more = more.where(~F.coalesce("ca", "a").eqNullSafe(F.coalesce("cb", "b"))).select("a", "b")
        more = keep(more, "jaccard-e")
        new, done = _alike(more, sets), done + runs
        found += new
        edges = more if edges is None else edges.union(more)
        if done > runs and more.first() is None:
            return groups
        groups = components(edges, "jaccard-c")
        if new <= (1 - recall) * found:
            return groups


def _exact(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks of a candidate group to link counts (g null) and spanning edges of its similarities."""
    free()
    for group in grouped(batches, ["c", "i", "j"]):
        f, copies = group.column("f").to_pylist(), group.column("copies").to_numpy().astype(np.float64)
        sizes = group.column("n").to_numpy().astype(np.float64)
        side = group.column("block").to_numpy()
        apart = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("runs").to_pylist()]
        common = np.zeros((len(f), len(f)), np.float32)
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(f)), [len(s) for s in sets])
        shared = np.flatnonzero(counts > 1)
        place = np.full(len(values), -1)
        place[shared] = np.arange(len(shared))
        column = place[inverse]
        keep_ = column >= 0
        column, owner = column[keep_], owner[keep_]
        for at in range(0, len(shared), 4096):
            here = (column >= at) & (column < at + 4096)
            has = np.zeros((len(f), min(4096, len(shared) - at)), np.float32)
            has[owner[here], column[here] - at] = 1
            common += has @ has.T
        union = sizes[:, None] + sizes[None, :] - common
        near = common >= similar * union - 1e-9
        np.fill_diagonal(near, False)
        if apart:
            near &= side[:, None] != side[None, :]
        links = near @ copies
        rows = [(x, int(n), None) for x, n in zip(f, links, strict=True) if n] + [(f[i], 0, f[j]) for i, j in spanning(near)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["f", "links", "g"])


def exact_links(docs: DataFrame, sets: DataFrame, groups: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """f, links, g: counts of linked documents (g null), and edges f, g that span each class. groups: node, component."""
    chosen = keep(groups.withColumnRenamed("node", "f").join(sets.select("f", "rep", "copies", "n"), "f"), "jaccard-chosen")
    wanted = chosen.select(F.col("rep").alias("want")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("want"))).select("doc_id", "text")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                own = [(fingerprint(s), s.tobytes()) for _, s in _sets(whole.slice(at, 256))]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*own, strict=True)], ["f", "runs"])

    runs = texts.mapInArrow(run, "f binary, runs binary").dropDuplicates(["f"])
    sizes = chosen.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_RUNS)).cast("long").alias("blocks"))
    rows = chosen.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("f"), F.col("blocks")))
    rows = rows.select("f", "copies", "n", F.xxhash64("component").alias("c"), "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k"))
    rows = rows.join(runs, "f").select("f", "copies", "n", "runs", "c", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    rows = rows.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")
    return rows.mapInArrow(lambda b: _exact(b, similar), "f binary, links long, g binary")


def classes(docs: DataFrame, similar: float = SIMILAR, runs: int = RUNS) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and of each set f: its class (the least set of it), class_id (the least doc_id) and n_links of each of its rows."""
    signed = keep(signatures(docs), "jaccard-sig")
    with_words = signed.where("f is not null")
    sets = with_words.groupBy("f").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = keep(sets, "jaccard-sets")
    groups = candidate_groups(sets, runs)
    exact = keep(exact_links(docs, sets, groups, similar), "jaccard-x")
    joined = components(exact.where("g is not null").select(F.col("f").alias("a"), F.col("g").alias("b")), "jaccard-k")
    links = exact.where("g is null").groupBy("f").agg(F.sum("links").alias("links"))
    placed = keep(joined.withColumnRenamed("node", "f").join(sets.select("f", "rep"), "f"), "jaccard-p")
    heads = placed.groupBy("component").agg(F.min("rep").alias("head"))
    placed = placed.select("f", "component").join(heads, "component").select("f", "component", "head")
    named = sets.select("f", "copies", "rep").join(links, "f", "left").join(placed, "f", "left")
    named = named.select("f", F.coalesce("component", "f").alias("class"), F.coalesce("head", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed, keep(named, "jaccard-m")


def join_documents(docs: DataFrame, similar: float = SIMILAR, runs: int = RUNS) -> DataFrame:
    """doc_id, class_id, n_links for every row of docs."""
    signed, named = classes(docs, similar, runs)
    out = signed.select("doc_id", "f").join(named.drop("class"), "f", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of docs of each class: that of least doc_id, then of least MD5 of its text; of repeated rows one. Rows without doc_id stay.

    A row is named by its doc_id and text together, so rows of other texts under the same doc_id are no matter."""
    signed, named = classes(docs, similar)
    members = signed.where("doc_id is not null and f is not null").select("doc_id", "copy", "f").distinct().join(named.select("f", "class"), "f")
    members = keep(members.select("class", F.struct("doc_id", "copy").alias("row")), "jaccard-rows")
    best = members.groupBy("class").agg(F.min("row").alias("best"))
    gone = members.join(best, "class").where("row != best").select(F.col("row.doc_id").alias("doc_id"), F.col("row.copy").alias("copy_"), F.lit(True).alias("drop_"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row, _copy().alias("copy_"))
    left = rows.join(gone, ["doc_id", "copy_"], "left").where("drop_ is null")
    named = left.where("doc_id is not null").withColumn("again_", F.row_number().over(W.partitionBy("doc_id", "copy_").orderBy("copy_"))).where("again_ = 1")
    return named.select("row_.*").union(left.where("doc_id is null").select("row_.*"))
