"""Quality classifier: a sparse rule ensemble (Friedman and Popescu, "Predictive learning via rule ensembles").

Shallow boosted trees are grown over text statistics; the path to each of their nodes is a
conjunctive rule. Rules and standardised statistics are weighted by a lasso logistic regression,
and the few with a weight are compiled into one Spark column expression, so scoring is a map
without Python and without a shuffle.

Training uses at most MOST_LABELS labelled rows: those whose hash of doc_id is least, which any
larger table samples alike. Null text counts as empty. Labels without doc_id or without a quality
are left out; of several for one doc_id the least counts. Every row of documents is scored once,
repeated ones as well, and other columns stay as they are, whatever their names; only a column
`score` is replaced. Without labels of both kinds the score is their share, 0.5 without any.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on at most; this bounds what is broadcast and collected.
MOST_LABELS = 20_000
ACCEPTED = 0.3

_WORD = r"[^\x20\x09-\x0D]+"


def _share(text: str, pattern: str) -> Column:
    """Share of the text's characters that runs of the pattern cover."""
    kept = F.length(F.regexp_replace(text, pattern, ""))
    return F.when(F.col("n_chars_") > 0, 1 - kept / F.col("n_chars_")).otherwise(F.lit(0.0))


def with_statistics(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """row, a struct of the columns of docs, and stats, a struct of doubles that the text alone decides; and their names.

    The statistics come out of a generator, below which no filter on them is pushed: each is computed once a row."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    out = docs.select(row, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t_"))
    out = out.withColumns({"n_chars_": F.length("t_"), "w_": F.regexp_extract_all("t_", F.lit(_WORD), F.lit(0)), "l_": F.split("t_", "\n")})
    n_words, n_lines = F.size("w_"), F.size("l_")
    stats = {
        "log_chars": F.log1p(F.col("n_chars_").cast("double")),
        "log_words": F.log1p(n_words.cast("double")),
        "chars_a_word": F.col("n_chars_") / F.greatest(n_words, F.lit(1)),
        "words_a_line": n_words / F.greatest(n_lines, F.lit(1)),
        "distinct_words": F.size(F.array_distinct("w_")) / F.greatest(n_words, F.lit(1)),
        "distinct_lines": F.size(F.array_distinct("l_")) / F.greatest(n_lines, F.lit(1)),
        "upper": _share("t_", r"\p{Lu}+"),
        "letters": _share("t_", r"\p{L}+"),
        "digits": _share("t_", r"\p{N}+"),
        "symbols": _share("t_", r"[^\p{L}\p{N}\s.,;:?'\"()-]+"),
        "stops": _share("t_", r"[.,;:?]+"),
        "short_words": _share("t_", r"(?<!\S)\S{1,3}(?!\S)"),
    }
    names = list(stats)
    return out.select("row", F.explode(F.array(F.struct(*(c.cast("double").alias(n) for n, c in stats.items())))).alias("stats")), names


@dataclass(frozen=True)
class Rule:
    """Statistics within bounds: (statistic, greater than, or at most, value)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, value in self.terms:
            out &= (x[:, j] > value) == above
        return out


@dataclass
class Ensemble:
    names: list[str]
    rules: list[Rule]
    rule_weights: np.ndarray
    low: np.ndarray
    high: np.ndarray
    scale: np.ndarray
    linear_weights: np.ndarray
    intercept: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r, w in zip(self.rules, self.rule_weights, strict=True):
            z += w * r.holds(x)
        z += (np.clip(x, self.low, self.high) * self.scale) @ self.linear_weights
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as one expression over the struct stats."""
        at = [F.col("stats")[n] for n in self.names]
        z = F.lit(float(self.intercept))
        for r, w in zip(self.rules, self.rule_weights, strict=True):
            test = F.lit(True)
            for j, above, value in r.terms:
                test = test & ((at[j] > value) if above else (at[j] <= value))
            z = z + F.when(test, F.lit(float(w))).otherwise(F.lit(0.0))
        for j, w in enumerate(self.linear_weights):
            if w:
                z = z + F.least(F.greatest(at[j], F.lit(float(self.low[j]))), F.lit(float(self.high[j]))) * float(self.scale[j] * w)
        return 1 / (1 + F.exp(-z))


def _grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, step: np.ndarray, shrink: float, least: int) -> None:
    """Grows a tree on gradients; each node's path joins `out`, each leaf's value `step`."""
    if path:
        out.append(Rule(tuple(sorted(path))))
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for j in range(bins.shape[1]):
            n = len(edges[j]) + 1
            own = bins[rows, j]
            sg, sh, sc = (np.bincount(own, weights=x, minlength=n).cumsum()[:-1] for x in (g[rows], h[rows], np.ones(len(rows))))
            gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
            gain[(sc < least) | (len(rows) - sc < least)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (j, int(gain.argmax())))
    if best[1] is None:
        step[rows] = -shrink * g[rows].sum() / (h[rows].sum() + 1)
        return
    j, k = best[1]
    above = bins[rows, j] > k
    for side in (False, True):
        _grow(bins, edges, g, h, rows[above == side], depth - 1, (*path, (j, side, float(edges[j][k]))), out, step, shrink, least)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], *, trees: int = 40, depth: int = 3, shrink: float = 0.2, penalty: float = 2e-3, rounds: int = 400) -> Ensemble:
    """The lasso-weighted rules of boosted trees; x: statistics, y: 0 or 1."""
    n, m = x.shape
    none = np.zeros(m)
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1)
        return Ensemble(names, [], np.zeros(0), none, none, none, none, float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64))) for j in range(m)]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin, rules = np.full(n, np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(n)
        _grow(bins, edges, p - y, p * (1 - p), np.arange(n), depth, (), rules, step, shrink, max(3, n // 500))
        margin += step
    kept: dict[bytes, Rule] = {}
    for r in rules:
        kept.setdefault(r.holds(x).tobytes(), r)
    rules = list(kept.values())
    low, high = np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)
    clipped = np.clip(x, low, high)
    spread = clipped.std(axis=0)
    scale = np.where(spread > 1e-9, 0.4 / np.maximum(spread, 1e-9), 0)
    z = np.concatenate([np.stack([r.holds(x) for r in rules], axis=1).astype(float) if rules else np.zeros((n, 0)), clipped * scale], axis=1)
    w, b = np.zeros(z.shape[1]), float(margin.mean())
    v, vb, t = w.copy(), b, 1.0
    u = np.ones(z.shape[1])
    for _ in range(20):  # the largest curvature, by power iteration
        u = z.T @ (z @ u)
        u /= np.linalg.norm(u) or 1
    rate = 1 / (0.25 * (np.linalg.norm(z @ u) ** 2 / n + 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ v + vb)))
        step = v - rate * (z.T @ (p - y)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new_b = vb - rate * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb, w, b, t = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b), new, new_b, t2
    kinds = np.flatnonzero(w[: len(rules)])
    return Ensemble(names, [rules[i] for i in kinds], w[kinds], low, high, scale, w[len(rules) :], b)


def remainder(by: int) -> Column:
    """crc32 of doc_id as text, modulo `by`; null without a doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def sample_labels(labels: DataFrame, label: str, most: int = MOST_LABELS) -> DataFrame:
    """doc_id and label of `most` rows at most that training may see: the least hashes."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label_")).where(F.col("doc_id").isNotNull() & F.col("label_").isNotNull())
    usable = usable.where(remainder(5) != 0).groupBy("doc_id").agg(F.min("label_").alias("label_"))
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELS) -> Ensemble:
    """Fits on a sample of labelled rows whose size `most` bounds, so it is broadcast and the texts aren't shuffled."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats, names = with_statistics(texts.join(F.broadcast(sample_labels(labels, label, most)), "doc_id"))
    # of rows with one id one is enough: no more come to the driver than labels were sampled
    stats = stats.groupBy("row.doc_id").agg(F.min("row.label_").alias("label_"), F.min("stats").alias("stats"))
    rows = stats.select("doc_id", "label_", *(F.col("stats")[n].alias(n) for n in names)).toPandas().sort_values("doc_id")
    return fit(rows[names].to_numpy(float), rows["label_"].to_numpy(float), names)


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """docs with the column score, from 0 to 1."""
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != "score"]
    return with_statistics(docs)[0].select(*kept, model.column().alias("score"))


def accepted(docs: DataFrame, model: Ensemble) -> DataFrame:
    """The rows and columns of docs whose text scores ACCEPTED or more."""
    return with_statistics(docs)[0].where(model.column() >= ACCEPTED).select("row.*")
