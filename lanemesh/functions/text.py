"""Address text: folding, tokens, phrase hits, ranking and fuzzy similarity."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _diacritics() -> tuple[str, str]:
    """Lower-case Latin letters with diacritics, and what is left without them. The stroke of đ is no diacritic, so đ isn't among them."""
    pairs = [(c, d[0]) for c in map(chr, [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower() and len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _diacritics()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FUZZY_ABOVE = 60.0


def fold(text: Column) -> Column:
    """Lower case without diacritics, combining marks included; đ stays."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.filter(F.split(F.coalesce(fold(text), F.lit("")), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def idf(rows: Column, rows_hit: Column) -> Column:
    return F.greatest(F.log((rows - rows_hit + 0.5) / (rows_hit + 0.5)), F.lit(LEAST_IDF))


def relevance(idf, hits, length, mean_length):
    """BM25 of a term, of columns or arrays alike."""
    return idf * hits * (K1 + 1) / (hits + K1 * (1 - B + B * length / mean_length))


def bm25(hits: Column, length: Column, rows: Column, rows_hit: Column, mean_length: Column) -> Column:
    """Relevance of a phrase, positive, higher is better; the phrase counts as one term."""
    return relevance(idf(rows, rows_hit), hits, length, mean_length)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def contains_like(text: Column, query: Column) -> Column:
    """text LIKE %query% with the case of ASCII letters ignored; % and _ in the query are wildcards, and its apostrophes count twice."""
    pattern = F.concat(F.lit("%"), ascii_lower(F.replace(query, F.lit("'"), F.lit("''"))), F.lit("%"))
    return F.call_function("like", ascii_lower(text), pattern)


def house_number_of(text: Column) -> Column:
    """The leading integer of `12 Street`, else null."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^([0-9]+)\s+(.+)$", 1), F.lit("")).try_cast("int")


def street_of(text: Column) -> Column:
    """What follows the leading integer, else the whole text, trimmed."""
    rest = F.regexp_extract(F.trim(text), r"^([0-9]+)\s+(.+)$", 2)
    return F.when(rest != "", F.trim(rest)).otherwise(F.trim(text))


def grams(text: Column, n: int = 3) -> Column:
    """Distinct runs of n characters."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.expr("array()").cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def like_grams(query: Column) -> Column:
    """Runs of three characters that every text holds which contains_like() finds: those between the pattern's wildcards and escapes."""
    parts = F.split(ascii_lower(F.replace(query, F.lit("'"), F.lit("''"))), r"[%_\\]+")
    return F.array_distinct(F.flatten(F.transform(parts, lambda part: grams(part))))


def _masks(text: str) -> dict[str, int]:
    """For each character, the bits of its places in the text."""
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _common(masks: dict[str, int], n: int, window: str) -> int:
    """Length of the longest common subsequence of a text of n characters, given by its masks, and a window."""
    every = (1 << n) - 1
    row = every
    for c in window:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & every
    return n - row.bit_count()


def partial_ratio_of(a: str | None, b: str | None) -> float:
    """The best ratio, 100 * 2 * longest common subsequence / (length of both), of the shorter text with a window of the longer, of its length, or shorter at either end."""
    short, long = sorted((a or "", b or ""), key=len)
    if not short:
        return 0.0 if long else 100.0
    n, masks = len(short), _masks(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(200.0 * _common(masks, n, w) / (n + len(w)) for w in windows)


def character_counts(texts: list[str], kinds: int = 64) -> np.ndarray:
    """Counts of code points, by their remainder of `kinds`, of each text."""
    out = np.zeros((len(texts), kinds), dtype=np.int32)
    for i, t in enumerate(texts):
        np.add.at(out[i], np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % kinds, 1)
    return out


def may_exceed(ask: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """Which rows of counts can have a partial ratio above `least` with the text of counts `ask`: no common subsequence is longer than what both have of each character, and no window is shorter than it."""
    shared = np.minimum(counts, ask).sum(axis=1)
    short = np.minimum(counts.sum(axis=1), ask.sum())
    return 200.0 * shared > least * (short + shared)


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio_of(x, y) for x, y in zip(a, b, strict=True)])
