"""Phrases in all texts: every hit and the best ones without a pair of query and text in a shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from lanemesh.functions.text import B, K1, LEAST_IDF
from lanemesh.operators import geocode, phrases, postings


def corpus(n=300):
    rng = random.Random(5)
    words = ["old", "older", "Oldest", "road", "roads", "lane", "é", "el", "9"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(n // 2)]
    return [(i, rng.choice([*texts, "", None]), rng.choice([50.0, 80.0, None])) for i in range(n)]


ASKED = ["old", "o", "old road", "OLD ro", "road lane el", "road lane e", "9 old older r", "zebra", "zebra old", "old zebra", "é", "-", None, "old road"]


def wanted(rows):
    import math

    fold = lambda s: (s or "").lower().replace("é", "e").replace("-", " ").split()
    texts = {i: fold(t) for i, t, _ in rows}
    mean, out = sum(map(len, texts.values())) / len(rows), {}
    for k, ask in enumerate(ASKED):
        if not (q := fold(ask)):
            continue
        hits = {i: sum(t[s : s + len(q) - 1] == q[:-1] and t[s + len(q) - 1].startswith(q[-1]) for s in range(len(t) - len(q) + 1)) for i, t in texts.items()}
        hits = {i: n for i, n in hits.items() if n}
        idf = max(math.log((len(rows) - len(hits) + 0.5) / (len(hits) + 0.5)), LEAST_IDF)
        out |= {(k, i): (n, idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(texts[i]) / mean))) for i, n in hits.items()}
    return out


@pytest.mark.parametrize("few", [False, True])
def test_hits_of_all_texts(spark, monkeypatch, few):
    if few:
        for name in ("WORDS", "PLACES", "OUT", "WAITING"):
            monkeypatch.setattr(phrases, name, 7)
    rows = corpus()
    want = wanted(rows)
    addresses = spark.createDataFrame(rows, "id long, address string, rank_score double")
    queries = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string")
    assert sorted(tuple(r) for r in phrases.counts(addresses, queries).collect()) == sorted((*at, n) for at, (n, _) in want.items())
    got = phrases.scored(addresses, queries).collect()
    assert len(got) == len(want) and all(want[r.query_id, r.id] == (r.hits, pytest.approx(r.relevance, abs=1e-12)) for r in got)
    rank = {i: -1.0 if r is None else r for i, _, r in rows}
    best = {(r.query_id, r.place): r.id for r in phrases.best(addresses, queries, 4, digits=9).collect()}
    for k in range(len(ASKED)):
        hit = sorted((-rank[i], -round(want[q, i][1], 9), i) for q, i in want if q == k)[:4]
        assert [best.pop((k, p), None) for p in range(1, len(hit) + 1)] == [h[2] for h in hit], ASKED[k]
    assert not best


def test_hits_are_not_shuffled(spark):
    addresses = spark.createDataFrame(corpus(), "id long, address string, rank_score double")
    queries = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string")
    plan = postings.phrase_search(addresses, queries)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.index("MapInArrow") < plan.index("Exchange")


def test_best_as_by_the_index(spark):
    rows = [(*r[:2], r[2] or 60.0) for r in corpus()]
    addresses = spark.createDataFrame(rows, "id long, address string, rank_score double")
    queries = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string")
    columns = ["query_id", "place", "id", F.round("relevance", 9)]
    by_index = geocode.phrase_top(postings.build(addresses), queries, 5, F.round("relevance", 9)).select(*columns)
    assert sorted(by_index.collect()) == sorted(phrases.best(addresses, queries, 5, 9).select(*columns).collect())


def test_hits_alone_take_one_pass(spark):
    addresses = spark.createDataFrame(corpus(), "id long, address string, rank_score double")
    queries = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query string")
    plan = phrases.counts(addresses, queries)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1 and plan.index("MapInArrow") < plan.index("Exchange")
