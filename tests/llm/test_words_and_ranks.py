"""License rules, ranked search and spelling variants, against brute force."""

import collections
import math
import random
import re
import re._parser as parser
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import jaccard, license_rules, licenses, ranked, spelling
from llm.tables import table

ASCII = str.maketrans(licenses.UPPER, licenses.LOWER)


# License rules


def expansion(pattern, rng):
    """A random text that the pattern matches."""
    out = ""
    for op, arg in pattern:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "NOT_LITERAL":
            out += rng.choice("abc")
        elif kind == "IN":
            one, value = rng.choice(arg)
            out += chr(value) if str(one) == "LITERAL" else chr(rng.randint(*value))
        elif kind == "SUBPATTERN":
            out += expansion(arg[3], rng)
        elif kind == "BRANCH":
            out += expansion(rng.choice(arg[1]), rng)
        else:
            least, most, inner = arg
            out += "".join(expansion(inner, rng) for _ in range(rng.randint(least, min(int(most), least + 8))))
    return out


def plain_scan(text, rules):
    """n_words, all detections (start, order, end, label, strength, base), and those kept."""
    found_words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
    flat = "".join(f" {w} " for w in found_words)
    found = []
    for r in rules:
        for m in re.finditer(r.pattern, flat):
            start = flat.count(" ", 0, m.start()) // 2
            found.append((start, r.order, start + m.group().count(" ") // 2, r.label, r.strength, r.base))
    kept = [d for d in found if d[5] or not any(o[1] < d[1] and o[0] <= d[0] and o[2] >= d[2] for o in found)]
    return len(found_words), sorted(found), sorted(kept)


def test_license_keywords_are_in_every_match():
    rng = random.Random(5)
    for rule in license_rules.parsed():
        tree = parser.parse(rule.pattern)
        for _ in range(40):
            text = expansion(tree, rng)
            own = text.split()
            assert text == "".join(f" {w} " for w in own) and len(own) <= license_rules.MOST_WORDS
            assert set(rule.keyword.split("/")) & set(own), (rule, text)


def test_license_detections_against_brute_force(spark, odd):
    rules, rng = license_rules.parsed(), random.Random(6)
    assert len(rules) > 300 and sum(r.base for r in rules) == 3
    trees = [parser.parse(r.pattern) for r in rules]
    texts = [" ".join(expansion(t, rng).upper() if rng.random() < 0.3 else expansion(t, rng) for t in rng.sample(trees, 6)) for _ in range(60)]
    texts += [expansion(t, rng) for t in trees] + ["cc by " * 3000, "GNU General Public License v3 " * 300 + "all rights reserved", "cc\x00by cc-by CC BY-NC 4.0", "ccby cc bye", None, ""]
    rows = [(i, t, [9], "x") for i, t in enumerate(texts)]
    got = licenses.detect(spark.createDataFrame(rows, "doc_id long, text string, found array<int>, row string")).collect()
    for r in got:
        n, found, kept = plain_scan(texts[r.row.doc_id], rules)
        assert (r.n_words, [tuple(x) for x in r.found], [tuple(x) for x in r.kept]) == (n, found, kept), texts[r.row.doc_id]
    assert len(got) == len(rows) and [r.row.row for r in got] == ["x"] * len(rows)


def test_license_query_and_odd_rows(spark, small, odd, nothing):
    docs = table(spark, small, "documents")
    rules = license_rules.parsed()
    text_of = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.scan_documents(docs).collect():
        n, found, kept = plain_scan(text_of[r.doc_id], rules)
        base = [d for d in found if d[5]]
        names = lambda x: ",".join(sorted({d[3] for d in x}))
        assert r[1:] == (n, len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None), names(base), names(kept), max((d[4] for d in kept), default=0.0))
    got = licenses.scan_documents(odd).collect()
    assert len(got) == odd.count() and all(r.labels == "" and r.score == 0 for r in got)
    assert licenses.scan_documents(nothing).count() == 0
    spans = licenses.labelled_documents(odd.withColumn("text", F.lit("Released under the MIT License."))).collect()
    assert len(spans) == odd.count() and {(r.label, r.start, r.end) for r in spans} == {("mit", 0, 5)}


def test_license_plan_is_native(spark, small):
    plan = licenses.scan_documents(table(spark, small, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def plain_ranks(docs, items, k=50):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("docs_a_shard", [16384, 7])
def test_ranked_search_against_brute_force(spark, small, odd, monkeypatch, docs_a_shard):
    monkeypatch.setattr(ranked, "DOCS", docs_a_shard)
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()] + [(r.doc_id, r.text) for r in odd.collect()]
    docs += [(1000 + i, "tie breaker words") for i in range(70)] + [(None, "tie breaker words")] * 2 + [(2000, "TIE-breaker\x00Words")] * 3
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    items += [(None, "words tie"), (7, "words tie"), (7, "words tie"), (7, "the fox"), (8, None), (9, ""), (10, "nowhere at all"), (11, "é ß 日本語 123")]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, score string").repartition(5)
    b = spark.createDataFrame([(*r, 1.0) for r in items], "item_id long, text string, key double")
    got = sorted((tuple(r) for r in ranked.rank_documents(d, b).collect()), key=repr)
    assert got == plain_ranks(docs, items)


def test_ranked_search_looks_at_few_nodes(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(20)) + (" rare pair" if i % 1000 == 0 else "")) for i in range(8000)]
    index = ranked.build(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    row = index.shards.first()
    import numpy as np
    import pyarrow as pa

    tree = ranked.Tree(pa.array(row.doc_ids), np.array(row.counts), np.frombuffer(row.impacts, np.int32), np.frombuffer(row.bits, np.uint8))
    looked = []
    real = np.argpartition
    monkeypatch.setattr(np, "argpartition", lambda *a: (looked.append(1), real(*a))[1])
    lists = np.array([row.terms.index("rare"), row.terms.index("a")])
    at, _ = tree.best(lists, np.array([5000, 10]), 5, (0, -1))
    assert len(at) == 5 and all(x % 1000 == 0 for x in tree.docs[at]) and len(looked) < 12


def test_terms_are_counted_in_bounded_memory():
    mixed = pa.array(["Ab, c2 \u00e9t\u00e9! " * 100, None, "", " .,"] * 2500 + ["x"])
    n = np.diff(ranked._terms(mixed)[1])
    assert ranked.counted(mixed) == (int((n > 0).sum()), int(n.sum())) == (2501, 750001)
    large = pa.array(["ab c " * 4000] * 1000)  # 20 MB in a batch; the hashes of its terms alone take 64
    tracemalloc.start()
    try:
        assert ranked.counted(large) == (1000, 8_000_000)
        assert tracemalloc.get_traced_memory()[1] < 64e6
    finally:
        tracemalloc.stop()


def test_ranked_search_of_nothing(spark, small, odd, nothing):
    items = table(spark, small, "benchmark")
    assert ranked.rank_documents(nothing, items).count() == 0
    assert ranked.rank_documents(odd, items.limit(0)).count() == 0
    assert ranked.rank_documents(odd.withColumn("text", F.lit(" .,")), items).count() == 0


# Spelling variants


def plain_words(docs):
    counts = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    counts = plain_words(docs)
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if counts[v] >= 2 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def made_words(rng, n):
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(n)]
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "abababa", "a" * 300, "a" * 301, "É" * 6, "é" * 6, "ÿÀÿÀÿ", "ÿÀÿÀÿÀ"]
    return base


@pytest.mark.parametrize("block, cells", [(8192, 1_000_000), (16, 50)])
def test_spelling_variants_against_brute_force(spark, monkeypatch, block, cells):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "CELLS", cells)
    monkeypatch.setattr(spelling, "ROWS", 500)
    rng = random.Random(block)
    docs = [(rng.choice([None, i]), " ".join(w for w in made_words(rng, 6) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    docs += [(None, None), (3, ""), (4, "1 2 3 ... ABCDE abcde Abcde abcdé " * 3), (4, "1 2 3 ... ABCDE abcde Abcde abcdé " * 3)]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, word string")
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(d).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(docs)


def test_spelling_variants_of_documents(spark, small, odd, nothing):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(table(spark, small, "documents")).collect()}
    assert got == plain_variants(docs)
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(odd).collect()}
    assert got == plain_variants([(r.doc_id, r.text) for r in odd.collect()])
    assert spelling.variants(nothing).count() == 0


# Near duplicates whose doc_id repeats


def test_one_of_each_keeps_other_texts_of_an_id(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, a + " more"), (4, b), (4, b + " more"), (5, "alone here"), (5, None), (5, None)]
    kept = jaccard.one_of_each(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, class int")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, a), (2, b), (5, "alone here"), (5, None)], key=repr)


def test_one_of_each_of_copies_under_one_id(spark):
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(1, a), (1, a + " more"), (1, a)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 1


# Passages: copies over tasks, and edited passages


def test_copies_over_many_tasks_are_seeded_once(spark):
    from llm import passages

    text = " ".join(f"w{i * i % 1009}" for i in range(300))
    rows = [(i if i % 3 else None, text, "x") for i in range(200)] + [(900, None, "x"), (901, "short", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tid string").repartition(20)
    texts = passages._words(docs)
    seeds = passages._seeds(texts).select("seed", "tid", "pos").collect()
    assert texts.count() == 1 and len(seeds) == len(set(seeds))
    got = passages.passages(docs).collect()
    assert {r.kind for r in got} == {"copy"} and len(got) == 199


@pytest.mark.parametrize("words_long", [60, 80, 120])
def test_edited_passages_are_found(spark, words_long):
    from llm import passages

    rng = random.Random(words_long)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for share in (0.05, 0.1, 0.15, 0.2):
        for _ in range(25):
            own = fresh(words_long)
            edited = list(own)
            for k in rng.sample(range(words_long), int(words_long * share)):
                edited[k] = f"x{rng.randrange(10**9)}"
            for p in (own, edited):
                rows.append((len(rows), " ".join(fresh(40) + p + fresh(40))))
    found = {tuple(sorted((r.doc_id, r.other_id))) for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(i, i + 1) for i in range(0, len(rows), 2)}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_the_widest_similar_stretch(spark):
    import numpy as np

    from llm import passages

    rng = np.random.default_rng(0)
    for _ in range(500):
        n = int(rng.integers(1, 40))
        equal = (rng.random(n) < rng.random()).astype(float)
        i, j = passages.widest(equal)
        most = max((b - a for a in range(n) for b in range(a + 1, n + 1) if equal[a] and equal[b - 1] and equal[a:b].sum() >= passages.SIMILAR * (b - a) - 1e-9), default=0)
        assert j - i <= most and (j == i or equal[i:j].sum() >= passages.SIMILAR * (j - i) - 1e-9) and (most == 0 or j > i)


def test_seeds_of_many_texts_at_once():
    from llm import passages

    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 2**32, n, dtype=np.uint32)[rng.integers(0, k, n) if k else np.arange(n)] for n in (50, 51, 75, 300) for k in (0, 1, 3, 40)]
    hashes, to = passages.shingles(passages._unpacked(b"".join(t.tobytes() for t in texts)), np.concatenate(([0], np.cumsum([len(t) for t in texts]))), passages.SEED)
    hashes = passages.mix(hashes)
    for window in (passages.WINDOW, passages.WIDE):
        want = np.concatenate([a + passages.minimizers(hashes[a:b], window) for a, b in zip(to, to[1:], strict=False)])
        assert passages.minimizers_of(hashes, to, window).tolist() == want.tolist()
    value, text, place = np.array([5, 7, 5, 5, 7]), np.array([0, 0, 0, 1, 1]), np.array([2, 4, 9, 1, 3])
    assert passages._first_of(value, text, place).tolist() == [2, 4, 2, 1, 3]
