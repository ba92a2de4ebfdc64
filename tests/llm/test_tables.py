"""Operators over whole tables, against brute force."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from llm import ann, jaccard, katz, merkle, mixing, passages, quality
from llm.tables import table

LOWER = bytes([c + 32 if 65 <= c <= 90 else c for c in range(256)])


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))


# Merkle audit


def archive(spark, damage=()):
    rows = []
    for f in range(5):
        at = 0
        for k in range(40):
            body = f"file {f} record {k}".encode() * (k + 1)
            rows.append([f, at, body])
            at += len(body)
    for i, change in damage:
        rows[i] = change(rows[i])
    return spark.createDataFrame([r for r in rows if r], "file_no long, offset long, payload binary"), rows


def test_merkle_finds_the_damage(spark):
    a, rows = archive(spark)
    b, _ = archive(spark, [(3, lambda r: [r[0], r[1], r[2][:-1] + b"?"]), (77, lambda r: None)])
    b = b.union(b.where("file_no = 4 and offset = 0")).union(spark.createDataFrame([(9, 5, b"new")], b.schema))
    got = {(r.file_no, r.offset, r.status) for r in merkle.audit(a, b, 1024, 4).collect()}
    assert got == {(rows[3][0], rows[3][1], "altered"), (rows[77][0], rows[77][1], "missing"), (4, 0, "copies"), (9, 5, "extra")}


def test_merkle_root_depends_on_every_record(spark):
    a, _ = archive(spark)
    b, _ = archive(spark, [(150, lambda r: [r[0], r[1], r[2] + b"."])])
    roots = []
    for x in (a, b, a.orderBy(F.rand(1))):
        h = merkle.hashed(x)
        roots.append(merkle.root(merkle.trees(h, "t", merkle.depths(h, 1024, 4), 1024, 4)))
    assert roots[0] == roots[2] != roots[1]


def test_merkle_odd_rows(spark):
    rows = [(None, None, None), (None, None, b""), (1, None, b"x"), (1, None, b"x"), (None, 3, b"y")]
    a = spark.createDataFrame([(*r, "clash") for r in rows], "file_no long, offset long, payload binary, hash string")
    assert merkle.audit(a, a).count() == 0
    assert {r.status for r in merkle.audit(a, a.limit(0)).collect()} == {"missing"}
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", None, 2), (1, "u", None, 2), (2, None, "h", 3)], "page_id long, url string, html string, offset int")
    assert merkle.audit_pages(pages).count() == 0
    placed = merkle.placed(*merkle.pages_archive(pages.union(pages))).collect()
    by_file = collections.defaultdict(list)
    for r in placed:
        by_file[r.file_no].append((r.offset, len(r.payload)))
    for own in by_file.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    assert merkle.audit_pages(pages.limit(0)).count() == 0


def test_merkle_long_payloads_and_many_records_without_offset(spark):
    long = spark.range(3).select(F.lit(0).cast("long").alias("file_no"), (F.col("id") * 10_000_000).alias("offset"), F.repeat(F.lit("x"), 5_000_000).cast("binary").alias("payload"))
    loose = spark.range(2000).select(F.lit(None).cast("long").alias("file_no"), F.lit(None).cast("long").alias("offset"), F.col("id").cast("string").cast("binary").alias("payload"))
    b = long.withColumn("payload", F.when(F.col("offset") > 0, F.expr("concat(payload, cast('y' as binary))")).otherwise(F.col("payload"))).union(loose.where("payload != cast('77' as binary)"))
    got = sorted((r.file_no, r.offset, r.status) for r in merkle.audit(long.union(loose), b).collect())
    assert got == [(-1, -1, "missing"), (0, 10_000_000, "altered"), (0, 20_000_000, "altered")]


# Quality


def plain_statistics(text):
    """The statistics of the docstring's names, in their order, with the regex module."""
    text = text or ""
    found, lines = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n")
    share = lambda p: sum(map(len, regex.findall(p, text))) / len(text) if text else 0.0
    n = max(1, len(found))
    shares = [share(p) for p in (r"\p{Lu}", r"\p{L}", r"\p{N}", r"[^\p{L}\p{N}\s.,;:?'\"()-]", r"[.,;:?]", r"(?<!\S)\S{1,3}(?!\S)")]
    return [math.log1p(len(text)), math.log1p(len(found)), len(text) / n, len(found) / len(lines), len(set(found)) / n, len(set(lines)) / len(lines), *shares]


def test_statistics_are_computed_once(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    kept = quality.accepted(docs, quality.train(docs, labels))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert kept.columns == docs.columns and plan.count("regexp_replace") <= 6 and plan.count("regexp_extract_all") <= 1


def test_rules_compile_to_the_same_scores(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    model = quality.train(docs, labels)
    stats, names = quality.with_statistics(docs)
    rows = stats.withColumn("s", model.column()).select("s", *(F.col("stats")[n] for n in names), "row.text").collect()
    for r in rows:
        assert np.allclose(r[1:-1], plain_statistics(r[-1]))
    rows = [r[:-1] for r in rows]
    assert np.allclose([r[0] for r in rows], model.predict(np.array([r[1:] for r in rows], float)))


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels)).join(labels, "doc_id").where(quality.remainder(5) == 0).collect()
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in scored) / len(scored) > 0.95


def test_lasso_drops_rules_that_tell_nothing():
    x = np.random.default_rng(1).random((2000, 6))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    m = quality.fit(x, y, list("abcdef"))
    assert ((m.predict(x) >= 0.5) == (y == 1)).mean() > 0.98
    assert len(m.rules) < 60


def test_quality_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (6, 0), (10, 1), (None, 0), (7, None), (7, 1), (8, 0)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    clash = odd.withColumns({c: F.lit(c) for c in ("t_", "w_", "l_", "n_chars_", "row", "label_")})
    scored = quality.score(clash, model)
    rows = scored.collect()
    assert sorted(scored.columns) == sorted(clash.columns)
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.w_ == "w_" and r.row == "row" and r.stats == "mine" for r in rows)
    many = odd.union(odd).union(odd)
    assert np.allclose(quality.train(many, labels).predict(np.ones((1, 12))), model.predict(np.ones((1, 12))))
    empty = quality.train(nothing, labels.limit(0))
    assert quality.score(nothing.select("doc_id", "text"), empty).count() == 0
    assert quality.fit(np.zeros((0, 2)), np.zeros(0), ["a", "b"]).predict(np.zeros((1, 2)))[0] == 0.5


# Katz


def katz_brute(rows, order):
    texts = [(i, ["^"] * (order - 1) + [*words(t), "$"]) for i, t in rows]
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7
    train = [w for i, w in texts if i is not None and fold(i) != 2]
    grams = lambda t, k: [tuple(t[j - k + 1 : j + 1]) for j in range(order - 1, len(t))]
    count = [None] + [collections.Counter(g for t in train for g in grams(t, k)) for k in range(1, order + 1)]
    numbers = lambda c: [sum(v == r for v in c.values()) for r in range(1, 7)] + [len(c), sum(c.values())]
    m = katz.Model({k: numbers(count[k]) for k in range(1, order + 1)}, len(train), order)
    kept = lambda g: float(m.kept(len(g), np.array([count[len(g)][g]]))[0])
    seen_after = lambda c: len(train) if c == ("^",) * len(c) else count[len(c)][c]
    follow = collections.defaultdict(set)
    for k in range(2, order + 1):
        for g in count[k]:
            follow[g[:-1]].add(g[-1:])

    @functools.cache
    def p(g):
        if len(g) == 1:
            return float(m.unigram(np.array([count[1][g]]))[0])
        return kept(g) / seen_after(g[:-1]) if count[len(g)][g] else alpha(g[:-1]) * p(g[1:])

    @functools.cache
    def alpha(c):
        if not seen_after(c):
            return 1.0
        return (1 - sum(kept(c + w) for w in follow[c]) / seen_after(c)) / (1 - sum(p(c[1:] + w) for w in follow[c]))

    out = []
    for i, t in texts:
        ends = grams(t, 1)
        base = sum(math.log10((count[1][w] + 1) / (m.total + m.vocabulary + 1)) for w in ends)
        score = sum(math.log10(p(g)) for g in grams(t, order))
        out.append((i, i is not None and fold(i) == 2, len(ends), sum(count[1][w] > 0 for w in ends), m.total, round(base, 5), round(score, 5)))
    return out, m, count, follow, p


@pytest.mark.parametrize(("chunk", "order"), [(400, 3), (10**6, 3), (400, 2), (900, 4), (900, 1)])
def test_katz_equals_brute_force(spark, small, odd, monkeypatch, chunk, order):
    monkeypatch.setattr(katz, "CHUNK", chunk)
    docs = table(spark, small, "documents").select("doc_id", "text").limit(80).union(odd.where("doc_id is null or doc_id != 5").select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    expected, *_ = katz_brute(rows, order)
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in katz.score_documents(docs, order).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_katz_partitions_grow_with_the_tokens(spark, small, monkeypatch):
    docs = table(spark, small, "documents").select("doc_id", "text").limit(40)
    before = sorted(katz.score_documents(docs).collect())
    monkeypatch.setattr(katz, "PART_TOKENS", 50)
    for a, b in zip(before, sorted(katz.score_documents(docs).collect()), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-12)


def test_katz_weights_sum_to_one(spark, small):
    rows = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").limit(60).collect()]
    _, m, count, follow, p = katz_brute(rows, 3)
    assert abs(sum(p(w) for w in count[1]) + m.unseen - 1) < 1e-9
    for c in [("^", "^"), ("^",), *list(follow)[:15], *list(follow)[-15:]]:
        assert abs(sum(p(c + w) for w in count[1]) + p((*c, "never seen")) - 1) < 1e-9


def test_katz_odd_rows(spark, odd, nothing):
    assert katz.score_documents(odd).count() == odd.count()
    assert katz.score_documents(nothing).count() == 0
    only_held = spark.createDataFrame([(i, "a b c") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens) for r in katz.score_documents(only_held).collect()} == {(0, 0)}


# Passages


def test_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"{rng.randrange(10**6):06d}" for _ in range(n)]
    shared, fuzzy = fresh(60), fresh(120)
    worn = [w if i % 11 else "changed" for i, w in enumerate(fuzzy) if i % 29]
    texts = {1: fresh(80) + shared + fresh(50), 2: shared + fresh(70), 3: fresh(10) + shared, 4: fresh(30) + fuzzy + fresh(9), 5: worn + fresh(40), 6: fresh(200), 7: fresh(300), 8: shared[:30] + fresh(100)}
    rows = [(i, " ".join(t)) for i, t in texts.items()] + [(9, " ".join(texts[6])), (None, " ".join(texts[7])), (10, "short copy"), (11, "short copy")]
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {frozenset((r.doc_id, r.other_id)) for r in got if r.kind == "passage"}
    assert {x for p in pairs for x in p} == {1, 2, 3, 4, 5}
    assert frozenset((4, 5)) in pairs
    for r in got:
        if r.kind == "passage" and {r.doc_id, r.other_id} <= {1, 2, 3}:
            assert texts[r.doc_id][r.start_word : r.end_word] == shared == texts[r.other_id][r.other_start : r.other_end]
    assert {(r.doc_id, r.other_id) for r in got if r.kind == "copy"} == {(9, 6), (None, 7)}


def test_passages_whose_parts_other_texts_hold(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"{rng.randrange(10**6):06d}" for _ in range(n)]
    lines, boiler, own = [fresh(30) for _ in range(5)], fresh(40), fresh(20)
    texts = [fresh(rng.randrange(9, 40)) + sum(rng.sample(lines, rng.randrange(1, 4)), []) + fresh(20) for _ in range(40)]
    texts += [fresh(9) + boiler + fresh(30) for _ in range(30)] + [fresh(7) + boiler + own + fresh(30) for _ in range(2)]
    texts += [["tie"] * 300, fresh(5) + ["tie"] * 120]
    got = [r for r in passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect() if r.kind == "passage"]
    for r in got:
        assert 2 * r.matched >= passages.SIMILAR * (r.end_word - r.start_word + r.other_end - r.other_start)
    holders = collections.defaultdict(set)
    for i, t in enumerate(texts[:-2]):
        for k in range(len(t) - passages.LEAST + 1):
            holders[tuple(t[k : k + passages.LEAST])].add((i, k))
    held = {run: own for run, own in holders.items() if len({i for i, _ in own}) > 1}
    assert len(held) > 100
    # rows that hold the run on both sides connect all its holders
    for own in held.values():
        at, names = dict(own), {i: i for i, _ in own}
        for _ in own:
            for r in got:
                a, b = r.doc_id, r.other_id
                if a in at and b in at and r.start_word <= at[a] and at[a] + passages.LEAST <= r.end_word and r.other_start <= at[b] and at[b] + passages.LEAST <= r.other_end:
                    names[a] = names[b] = min(names[a], names[b])
            if len(set(names.values())) == 1:
                break
        assert len(set(names.values())) == 1
    assert {70, 71} <= {x for r in got for x in (r.doc_id, r.other_id)} and {72, 73} in [{r.doc_id, r.other_id} for r in got]


def test_run_hashes_tell_runs_apart():
    words = np.array([3, 1, 2, 3, 1, 2, 3, 2, 1, 3, 1], np.uint64)
    hashes = passages.run_hashes(words, 3).tolist()
    runs = [tuple(words[i : i + 3].tolist()) for i in range(9)]
    assert len(set(zip(runs, hashes, strict=True))) == len(set(runs)) == len(set(hashes))
    assert len(passages.run_hashes(words, 12)) == 0


def test_chains_maximise_the_score():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x0, y0, n = rng.integers(0, 60, 9), rng.integers(0, 60, 9), rng.integers(0, 12, 9)
        x1, y1, seeds = x0 + n, y0 + n, n // 3 + 1

        def value(c, x0=x0, y0=y0, x1=x1, y1=y1, seeds=seeds):
            return passages.SEED * seeds[c].sum() - passages.GAP * (x1[c[-1]] - x0[c[0]] + y1[c[-1]] - y0[c[0]])

        order = np.argsort(x0, kind="stable").tolist()
        best = max(value(c) for n in range(1, 10) for c in map(list, itertools.combinations(order, n)) if all(x1[i] < x0[j] and y1[i] < y0[j] for i, j in zip(c, c[1:], strict=False)))
        assert abs(value(passages.chains(x0, y0, x1, y1, seeds)[0]) - best) < 1e-9


def test_matches_join_seeds_on_a_diagonal():
    x, y = np.array([30, 0, 4, 9, 200, 5, 4]), np.array([31, 1, 5, 10, 201, 50, 5])
    assert [tuple(map(int, m)) for m in zip(*passages.matches(x, y), strict=True)] == [(5, 50, 5, 50, 1), (0, 1, 9, 10, 3), (30, 31, 30, 31, 1), (200, 201, 200, 201, 1)]


def test_common_subsequence():
    assert passages.common_subsequence(list(b"abcbdab"), list(b"bdcaba")) == 4
    assert passages.common_subsequence([], [1]) == 0


def test_passages_odd_rows(odd, nothing):
    assert {r.kind for r in passages.passages(odd).collect()} <= {"copy", "passage"}
    assert passages.passages(nothing).count() == 0


# Neighbours


def test_hilbert_neighbours_are_adjacent():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    keys = ann.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_ann_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)) * rng.random((3000, 1)) * 3
    x[100:400] = x[100]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    bad = [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] + [1.0] * 15, 0), (5060, [None] + [1.0] * 15, 0), (5080, [1.0] * 3, 0), (None, [1.0] * 16, 0), (5100, [], 0)]
    df = spark.createDataFrame(rows + bad + rows[:50], "vec_id long, embedding array<double>, score int")
    found = collections.defaultdict(list)
    for r in sorted(ann.search(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append(r.vec_id)
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-9
    assert set(found) == set(range(0, 3000, 20)) and all(len(v) == 20 for v in found.values())
    assert ann.recall(found, np.arange(3000), x) > 0.95
    assert ann.search(df.limit(0)).count() == 0
    few = {(r.query_id, r.vec_id) for r in ann.search(df.where("vec_id < 5")).collect()}
    assert few == {(0, i) for i in range(1, 5)}
    lengths = {(r.query_id, r.vec_id) for r in ann.search(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [1.0, 2.0]), (21, [3.0, 4.0])], "vec_id long, embedding array<float>")).collect()}
    assert lengths == {(0, 1), (20, 21)}


@pytest.mark.parametrize("n", [300, 440])
def test_ann_ties_go_to_the_least_ids(spark, n):
    rng = np.random.default_rng(5)
    x = np.concatenate((np.full((n, 1), 2.0), rng.integers(-9, 10, (n, 7)) / 4), axis=1)
    x[0] = [1.0] + [0.0] * 7  # of the same product with all others
    ids = rng.permutation(np.arange(1, n)) * 20 + 1
    rows = [(0, x[0].tolist())] + [(int(i), v.tolist()) for i, v in zip(ids, x[1:], strict=True)]
    got = sorted((r["rank"], r.vec_id, r.score) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(k + 1, int(i), 2.0) for k, i in enumerate(sorted(ids)[:20])]


def test_ann_windows_span_blocks_and_deals(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "DEAL", 3)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for half, least in ((30, 0.8), (450, 1.0)):
        found = collections.defaultdict(list)
        for r in sorted(ann.search(df, orderings=12, half=half).collect(), key=lambda r: (r.query_id, r["rank"])):
            found[r.query_id].append(r.vec_id)
        assert len(found) == 45 and ann.recall(found, np.arange(900), x) >= least


# Jaccard


def half_alike(pairs):
    """Texts that share 60% of their words, and of each the tail of ten words changed: those two are similar."""
    rng = random.Random(5)
    fresh = lambda n: [f"{rng.randrange(10**8)}" for _ in range(n)]
    common, rows = fresh(60), []
    for i in range(pairs):
        own = fresh(30)
        rows += [(2 * i + k, " ".join(common + own + fresh(10))) for k in range(2)]
    return rows


def test_jaccard_recall_where_texts_share_most_words(spark):
    df = spark.createDataFrame(half_alike(1200), "doc_id long, text string")
    got = jaccard.join_documents(df, runs=2).collect()
    assert sum(r.n_links for r in got) >= 0.97 * 2400
    assert all(r.n_links <= 1 and r.class_id == r.doc_id - r.doc_id % 2 * (r.n_links > 0) for r in got)


def test_jaccard_last_level_compares_all_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "DEPTH", 1)
    monkeypatch.setattr(jaccard, "LOCAL", 0)
    signed = jaccard.signatures(spark.createDataFrame(half_alike(2500), "doc_id long, text string")).collect()
    sets = spark.createDataFrame([(r.f, r.sig) for r in signed], "f binary, sig binary")
    edges = {frozenset((bytes(r.a), bytes(r.b))) for r in jaccard.candidate_edges(sets, 1).collect()}
    sigs = np.stack([np.frombuffer(r.sig, np.uint32) for r in signed])
    rows, keys = jaccard._children(np.full(len(sigs), jaccard.mix(np.array([1], np.uint64))[0]), sigs)
    root = {i: k for i, k in zip(rows.tolist(), keys.tolist(), strict=True)}
    assert max(collections.Counter(keys.tolist()).values()) > jaccard.PART
    by_id = {r.doc_id: i for i, r in enumerate(signed)}
    alike = [(a, b) for a, b in ((by_id[2 * k], by_id[2 * k + 1]) for k in range(2500)) if root[a] == root[b] and (sigs[a] == sigs[b]).mean() >= 0.75]
    assert len(alike) > 500
    assert all(frozenset((bytes(signed[a].f), bytes(signed[b].f))) in edges for a, b in alike)



@pytest.mark.parametrize("local", [8192, 100])
def test_jaccard_equals_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(jaccard, "LOCAL", local)
    rng = random.Random(7)
    fresh = lambda n: [f"{rng.randrange(10**5)}" for _ in range(n)]
    texts = {}
    base = fresh(150)
    for i in range(260):  # one group beyond SMALL
        t = list(base)
        t[rng.randrange(150)] = f"n{i}"
        texts[i] = t
    for i in range(260, 330, 2):
        texts[i] = fresh(120)
        texts[i + 1] = [w if rng.random() > 0.01 * (i % 7) else "z" for w in texts[i]]
    for i in range(330, 360):
        texts[i] = texts[i - 40]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    sets = {i: frozenset(tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))) for i, t in texts.items()}
    links, up = collections.Counter(), {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            i, j = find(a), find(b)
            up[max(i, j)] = min(i, j)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join_documents(docs).collect()}
    assert got == {i: (find(i), links[i]) for i in texts}


def test_jaccard_of_a_large_group_of_different_near_copies(spark):
    rng = random.Random(11)
    base = [f"{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(3000):
        t = list(base)
        t[rng.randrange(400)] = f"own{i}"
        rows.append((i, " ".join(t)))
    rows += [(5000 + i, " ".join(f"{rng.randrange(10**6)}" for _ in range(100))) for i in range(500)]
    got = jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in got if r.doc_id < 3000} == {(0, 2999)}
    assert all((r.class_id, r.n_links) == (r.doc_id, 0) for r in got if r.doc_id >= 3000)


def test_jaccard_odd_rows(odd, nothing):
    got = jaccard.join_documents(odd).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.class_id, r.n_links))
    assert by[1] == {(1, 2)} == by[6] and by[7] == {(7, 1)} and by[8] == {(7, 1)} and by[2] == {(2, 0)} and by[None] == {(None, 0)}
    left = jaccard.one_of_each(odd)
    assert left.columns == odd.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 7, 9, 10]
    assert jaccard.join_documents(nothing).count() == 0 and jaccard.one_of_each(nothing).count() == 0


# Mixing


def test_targets_fill_by_weight_up_to_three_times(spark):
    sums = spark.createDataFrame([("sa", 10), ("sb", 1000), ("sc", 1000), ("sd", 7)], "skey_ string, size_ long")
    got = {r.skey_: r.target for r in mixing.source_targets(sums).collect()}
    targets, left, weights = {}, 2017.0, {"sa": 5, "sb": 2, "sc": 1, "sd": 5}
    cap = {"sa": 30, "sb": 3000, "sc": 3000, "sd": 21}
    active = set(weights)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in active) for s in active}
        over = [s for s in active if share[s] > cap[s]]
        if not over:
            targets |= share
            break
        for s in over:
            targets[s] = cap[s]
            left -= cap[s]
            active.discard(s)
    assert all(abs(got[s] - targets[s]) < 1e-6 for s in targets)


def test_training_time_inverts_the_schedule(spark):
    knots = (0.0, 0.25, 0.5, 1.0)
    rates = [0.5, 2.0, 0.0, 1.0]
    df = spark.range(101).select((F.col("id") / 100).alias("q"), F.array(*map(F.lit, rates)).alias("w"))
    grid = np.linspace(0, 1, 200_001)
    done = np.concatenate(([0], np.cumsum((np.interp(grid, knots, rates)[1:] + np.interp(grid, knots, rates)[:-1]) / 2)))
    done /= done[-1]
    for r in df.select("q", mixing.training_time(F.col("q"), F.col("w"), knots).alias("t")).collect():
        assert abs(np.interp(r.t, grid, done) - r.q) < 1e-4


def test_mix(spark, odd, nothing, small):
    docs = table(spark, small, "documents")
    rows = mixing.mix_table(docs).collect()
    by = collections.defaultdict(lambda: [0, 0.0])
    sources = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by[sources[r.doc_id]][0] += r.taken
        by[sources[r.doc_id]][1] = r.target
    assert all(abs(a - b) <= 1 for a, b in by.values())
    places = [r.position for r in rows if r.position is not None]
    assert places == sorted(places) and places[-1] <= 1
    assert rows == mixing.mix_table(docs.repartition(3)).collect()
    got = mixing.mix_table(odd).collect()
    assert len(got) == odd.count()
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and {r.stats for r in mixed.collect()} == {"mine"}
    assert mixing.mix_table(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    own = spark.createDataFrame([("src0", [0.0, 1.0, 2.0])], "source string, weights array<double>")
    late = mixing.assign(docs, own).where("source = 'src0' and size(positions) > 0").agg(F.avg(F.element_at("positions", -1))).first()[0]
    assert late > 0.5


def test_mixing_runs_no_python(spark, small):
    plan = mixing.mix_table(table(spark, small, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Pipeline


def test_pipeline(spark, small):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "dedup", "secrets", "mix", "encode"]
    docs = table(spark, small, "documents")
    kept = corpus_pipeline.quality_stage(spark, docs, small)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    out = corpus_pipeline.run(spark, small).collect()
    assert out and all(len(r.token_ids) == r.n_tokens for r in out)
    assert hashlib.sha256(b"").hexdigest() not in {r.ids_sha256 for r in out}


def test_pipeline_odd_rows(spark, odd, nothing, tmp_path):
    import corpus_pipeline

    clash = odd.withColumns({c: F.lit(c) for c in ("row", "row_", "again_", "drop_", "t_", "label_")})
    labels = spark.createDataFrame([(1, 1), (5, 1), (6, 1), (9, 1), (4, 0), (None, 0), (7, None)], "doc_id long, quality int")
    for name, docs in (("odd", clash), ("nothing", nothing)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        now = table(spark, f"{tmp_path}/{name}", "documents")
        for stage, run in corpus_pipeline.STAGES[:-1]:
            now = run(spark, now, f"{tmp_path}/{name}")
            assert now.columns == docs.columns, stage
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(out) == now.count() and (out or name == "nothing")
        assert all(len(r.token_ids) == r.n_tokens for r in out)
        texts = {r.text for r in now.collect()}
        assert not any("hunter2" in (t or "") for t in texts)
