"""Spelling variants: words one edit apart, found through an inverted index of positional bigrams.

Words are counted on Spark. Two words that differ by one inserted, deleted or replaced code point share
max(length) - 3 bigrams at least, at the same place or, behind an inserted code point, at the next one.
Bigrams are ordered from rare to frequent; a word's keys are its rarest bigrams, up to the first two
that no one edit can touch both (with all places of each), so two near words share a key. A posting is
a word at (bigram, place, length). A word also asks the lists of words one longer, at its place and the
next. Lists are shuffled by key and merged in tasks: for all words that meet under a key the postings
of all their bigrams are merged, shared ones counted, pairs under the bound go, the rest is verified.

A key with more than BLOCK rows is dealt out: its rows in blocks, one task a pair of blocks. A word's
near words are bounded by its length and the alphabet, so one group by word ends the search.

Null texts have no runs. A null doc_id counts as an empty one in the checksum. Repeated rows count
each. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.licenses import LOWER, UPPER
from llm.tables import keep

RUN = "[A-Za-zÀ-ÿ]+"
#: Fixed by the contract: shortest word, least count, which runs lose a code point, and how much more frequent a form is.
SHORTEST, LEAST, DAMAGED, TIMES = 5, 3, 97, 2
#: Letters a-z, then U+00C0 to U+00FF. Bigrams of them bound the table of bigram counts.
LETTERS = 26 + 64
BLOCK = 8192
#: Pairs of words merged at a time in a task, and postings read before the first merge.
CELLS, ROWS = 1_000_000, 40_000
POSTING = "key long, length int, role int, word string, n long"


def counted(docs: DataFrame) -> DataFrame:
    """word, n: runs after the contract's damage, of SHORTEST code points or more, that occur LEAST times or more."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= SHORTEST).withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def bigram_ranks(words: DataFrame) -> np.ndarray:
    """The rank of each bigram by its count, rare ones first; LETTERS squared counts are all that the driver gets."""
    place = F.explode(F.sequence(F.lit(1), F.length("word") - 1))
    rows = words.select("word", place.alias("p")).groupBy(F.substring(F.col("word"), F.col("p"), F.lit(2)).alias("g")).count().collect()
    counts = np.zeros(LETTERS * LETTERS, np.int64)
    if rows:
        codes, _ = letters(pa.array([r.g for r in rows]))
        counts[codes[0::2] * LETTERS + codes[1::2]] = [r["count"] for r in rows]
    ranks = np.empty(len(counts), np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    return ranks


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words in a row as 0 to LETTERS - 1, and each word's first (len+1 offsets)."""
    text = "".join(column.to_pylist())
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = pa.compute.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(codes < 0xC0, codes - ord("a"), codes - 0xC0 + 26), np.concatenate(([0], np.cumsum(lengths)))


def bigrams(codes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bigrams in a row, with the word and the place of each."""
    length = np.diff(firsts)
    word = np.repeat(np.arange(len(length)), length - 1)
    place = np.arange(len(word)) - np.repeat(np.cumsum(length - 1) - (length - 1), length - 1)
    at = firsts[:-1][word] + place
    return codes[at] * LETTERS + codes[at + 1], word, place


def keys(gram: np.ndarray, word: np.ndarray, place: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Which bigrams are keys of their words: the rarest until two are not neighbours, and all of the same ranks."""
    rank = ranks[gram]
    order = np.lexsort((place, rank, word))
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])  # words keep their borders in the order
    a, b = order[first], order[first + 1]
    near = np.abs(place[a] - place[b]) < 2
    last = np.where(near, order[np.minimum(first + 2, len(order) - 1)], b)
    return rank <= rank[last][np.cumsum(np.r_[False, word[1:] != word[:-1]])]


def postings(words: DataFrame, ranks: np.ndarray) -> DataFrame:
    """A word's own postings (role 0), and what it asks of the lists of words one longer (role 1)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, firsts = letters(batch.column(0))
            gram, word, place = bigrams(codes, firsts)
            own = keys(gram, word, place, ranks)
            gram, word, place = gram[own], word[own], place[own]
            length = np.diff(firsts)[word]
            for role, more, shift in ((0, 0, 0), (1, 1, 0), (1, 1, 1)):
                key = ((place + shift) << 13 | gram) << 24 | (length + more)
                picked = pa.array(word)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array((length + more).astype(np.int32)), pa.array(np.full(len(key), role, np.int32)), batch.column(0).take(picked), batch.column(1).take(picked)], ["key", "length", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(emit, POSTING)


def dealt(rows: DataFrame) -> DataFrame:
    """rows with the pair of blocks (x, y) in which they meet, and their own block: one block for keys of BLOCK rows or fewer."""
    hot = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    rows = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "length", "role", "word", "n")


def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups by key, x, y of sorted batches, of about ROWS rows, or of one group that has more."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        new = borders(table)
        if new[-1]:
            yield table.slice(0, new[-1])
        held = table.slice(new[-1]).to_batches()
        rows = table.num_rows - int(new[-1])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def borders(table: pa.Table) -> np.ndarray:
    """Rows at which a group begins."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in ("key", "x", "y"):
        v = table[name].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def merged(left: np.ndarray, right: np.ndarray, codes: tuple, group: np.ndarray, bound: np.ndarray, shifts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of left, of right, in one group) that share `bound` of their group bigrams at least: all pairs of equal postings are merged and counted. left and right are sorted by group.

    shifts: how many places later than in `right` the bigram may stand in `left`."""
    gram, word, place, firsts = codes
    n_left, n_right = np.bincount(group[left], minlength=len(bound)), np.bincount(group[right], minlength=len(bound))
    base = np.concatenate(([0], np.cumsum(n_left * n_right)))
    in_left, in_right = np.cumsum(n_left) - n_left, np.cumsum(n_right) - n_right
    wide = int(place.max()) + 2 if len(place) else 2

    def expand(rows):
        count = firsts[rows + 1] - firsts[rows]
        at = np.repeat(firsts[rows] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(np.arange(len(rows)), count), at

    i, at = expand(left)
    code = (group[word[at]] * wide + place[at]) * LETTERS * LETTERS + gram[at]
    order = np.argsort(code, kind="stable")
    code, i = code[order], i[order]
    j, at = expand(right)
    g, h = group[left], group[right]
    row, column = base[g] + (np.arange(len(left)) - in_left[g]) * n_right[g], np.arange(len(right)) - in_right[h]
    counts = np.zeros(base[-1], np.int64)
    for shift in shifts:
        ask = (group[word[at]] * wide + place[at] + shift) * LETTERS * LETTERS + gram[at]
        lo, hi = np.searchsorted(code, ask, "left"), np.searchsorted(code, ask, "right")
        many = hi - lo
        k = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        a, b = i[k], np.repeat(j, many)
        counts += np.bincount(row[a] + column[b], minlength=len(counts))
    cell = np.flatnonzero(counts > 1)  # no bound is less than two
    g = np.searchsorted(base, cell, "right") - 1
    enough = counts[cell] >= bound[g]
    cell, g = cell[enough] - base[g[enough]], g[enough]
    return left[in_left[g] + cell // n_right[g]], right[in_right[g] + cell % n_right[g]]


def one_apart(a: np.ndarray, b: np.ndarray, codes: np.ndarray, firsts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which pairs differ by exactly one edit; words a are as long as b or one longer, `length` the length of a."""
    out = np.zeros(len(a), bool)
    same = length[b] == length[a]
    for size, equal in {(int(s), bool(e)) for s, e in zip(length[a], same, strict=True)}:
        own = np.flatnonzero((length[a] == size) & (same == equal))
        x = codes[firsts[a[own]][:, None] + np.arange(size)]
        if equal:
            out[own] = (x != codes[firsts[b[own]][:, None] + np.arange(size)]).sum(axis=1) == 1
        else:
            y = codes[firsts[b[own]][:, None] + np.arange(size - 1)]
            head = np.cumprod(x[:, :-1] == y, axis=1).sum(axis=1)
            tail = np.cumprod((x[:, 1:] == y)[:, ::-1], axis=1).sum(axis=1)
            out[own] = head + tail >= size - 1
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in complete(batches):
        first = borders(table)
        size = np.diff(np.r_[first, table.num_rows])
        wide = np.repeat(size >= 2, size)  # a word alone under its key has no pair
        table = table.filter(pa.array(wide))
        if not table.num_rows:
            continue
        words = table["word"].combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        codes, firsts = letters(words)
        gram, word, place = bigrams(codes, firsts)
        length, starts = np.diff(firsts), np.concatenate(([0], np.cumsum(np.diff(firsts) - 1)))
        role, block = table["role"].to_numpy(), table["block"].to_numpy()
        x, y = table["x"].to_numpy(), table["y"].to_numpy()
        listed, n = table["length"].to_numpy(), table["n"].to_numpy()
        first = borders(table)
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, table.num_rows]))
        for left, right, equal in _chunks(first, group, role, block, x, y):
            g = group[left[0]]
            bound = listed[first] - 3  # max(length) - 3
            local = group - g
            a, b = merged(left, right, (gram, word, place, starts), local, bound[g : group[max(left[-1], right[-1])] + 1], (0,) if equal else (0, 1))
            if equal:
                keep_ = a < b
                a, b = a[keep_], b[keep_]
            good = one_apart(a, b, codes, firsts, length)
            a, b = a[good], b[good]
            if len(a):
                i, j = np.r_[a, b], np.r_[b, a]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(i)), words.take(pa.array(j)), pa.array(n[j])], ["word", "near", "near_n"])


def _chunks(first, group, role, block, x, y):
    """Rows to merge at a time, CELLS pairs of them at most where a row has fewer: own words with own words, then with the shorter words that ask."""
    rows = np.arange(len(group))
    own, ask, lower = role == 0, role == 1, block == x
    split = x != y
    sides = [
        (own & ~split, own & ~split, True),
        (own & split & lower, own & split & ~lower, None),
        (own & ~split, ask & ~split, False),
        (own & split & lower, ask & split & ~lower, False),
        (own & split & ~lower, ask & split & lower, False),
    ]
    for a, b, equal in sides:
        left, right = rows[a], rows[b]
        n_left, n_right = np.bincount(group[left], minlength=len(first)), np.bincount(group[right], minlength=len(first))
        both = np.flatnonzero((n_left > 0) & (n_right > 0))
        at_left, at_right = np.r_[0, np.cumsum(n_left)], np.r_[0, np.cumsum(n_right)]
        start = 0
        while start < len(both):
            cells = np.cumsum(n_left[both[start:]] * n_right[both[start:]])
            stop = start + max(1, int(np.searchsorted(cells, CELLS, "right")))
            g, h = both[start], both[stop - 1]
            own_left, own_right = left[at_left[g] : at_left[h + 1]], right[at_right[g] : at_right[h + 1]]
            own_left, own_right = own_left[np.isin(group[own_left], both[start:stop])], own_right[np.isin(group[own_right], both[start:stop])]
            step = len(own_right) if stop - start > 1 else max(1, CELLS // len(own_left))
            for k in range(0, len(own_right), step):
                yield own_left, own_right[k : k + step], equal
            start = stop


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: all pairs of words one edit apart, both ways, each at least once."""
    rows = dealt(postings(words, bigram_ranks(words)))
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return rows.mapInArrow(_near, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for words with a form (word, form): steps are doubled, so rounds are the logarithm of the longest path. Counts double with each step, so paths are short."""
    now = keep(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        to = now.select(F.col("word").alias("root"), F.col("root").alias("to"))
        after = keep(now.join(to, "root", "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "spelling-roots")
        now = after.select("word", "root")
        if after.where("moved").first() is None:
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    words = keep(counted(docs), "spelling-words")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    pairs = near_words(words).repartition("word").dropDuplicates(["word", "near"])
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    out = words.join(near, "word", "left")
    good: Column = F.col("best.near_n") >= TIMES * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, F.col("best.near_n")).alias("form_n"))
    out = keep(out, "spelling-forms")
    return out.join(roots(out.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


VARIANTS_SQL = rf"""
WITH RECURSIVE steps AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
each AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY ALL),
coded AS (SELECT id, run, k, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM each),
summed AS (SELECT run, k, xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded, steps),
damaged AS (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
holes AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON h.rest = w.word
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON h.rest = w.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON walk.at = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON walk.at = forms.word WHERE forms.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""
