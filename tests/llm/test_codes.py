"""Codes of vectors: their bound holds, and nothing that exact scores would find is lost by them."""

import numpy as np
import pytest

from llm import ann


@pytest.mark.parametrize("factor", [1e-310, 1e-30, 1.0, 1e30, 1e150])
def test_bound_of_codes(factor):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 24)) * factor * 10.0 ** rng.integers(-3, 4, size=(500, 1))
    x[0] = np.eye(24)[3] * factor
    near, far = ann.decode(ann.pa.array([c.tobytes() for c in ann.encode(x)]), 24)
    queries = rng.normal(size=(20, 24))
    with np.errstate(under="ignore"):
        assert (np.abs(near @ queries.T - x @ queries.T) <= far[:, None] * np.linalg.norm(queries, axis=1) + ann.ROUNDING * np.abs(near @ queries.T).max(axis=0)).all()


def test_possible_keeps_all_that_may_be_among_the_greatest():
    rng = np.random.default_rng(5)
    for _ in range(50):
        far = rng.random(300) * 0.2
        exact = rng.normal(size=300)
        kept = ann.possible(exact + rng.uniform(-1, 1, 300) * far, far)
        assert set(np.argsort(-exact)[: ann.MOST_IDS]) <= set(kept)
    unknown = ann.possible(np.full(300, np.nan), np.full(300, np.inf))
    assert len(unknown) == 300


def test_windows_over_all_rows_find_all(spark):
    """Near ties, lengths from 1e-6 to 1e6, one vector near to every query, equal vectors: as all pairs have it."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16))
    x[200:260] = x[7] + rng.normal(size=(60, 16)) * 1e-7
    x[300:330] *= 1e-6
    x[330:340] *= 1e6
    x[350:390] = x[20]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, v string")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df, orderings=2, half=200).collect()}
    for q in range(0, 400, 20):
        scores = (x * x[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(400), -scores)) if i != q][: ann.TOP]
        assert [got[q, k + 1] for k in range(ann.TOP)] == [(i, scores[i]) for i in best]
    assert len(got) == 20 * ann.TOP
