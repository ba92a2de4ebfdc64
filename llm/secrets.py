"""Secret scans through a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived (Cox, "Regular expression matching
with a trigram index"): strings that match must hold some trigrams. One pass over the bytes of a batch of
documents notes which of the trigrams that any rule asks for occur where: sorted postings, from a
trigram to the documents that hold it. A rule's postings are intersected and united, and the regex
runs over the candidates alone. A rule without mandatory trigrams runs over every document.

Trigrams are of UTF-8 bytes, A-Z as a-z. The rules are written so that a scan takes time in
proportion to the text, however long a run of one kind of character is.

Null text counts as empty and yields no spans. Every row yields one row, repeated ones as well;
columns other than doc_id and text are not read. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as sre
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tables import once
from llm.words import column_bytes, lowered

#: Alternatives that a part of a regex is followed through at most, before it counts as "anything".
MOST_STRINGS = 64

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches of `pattern`, leftmost without overlap, whose group `group` has `least` characters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    compiled: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern, re.ASCII | re.IGNORECASE * self.any_case))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: Fixed by the contract of the query; the order is that of ties.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Further kinds, by their issuers' public formats.
MORE = (
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pay", r"sk_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("login", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s:/@]++:[^\s:/@]++@[^\s/]++"),
)
RULES = BASE + MORE

ANY = frozenset({frozenset()})


def _either(queries) -> frozenset:
    """A disjunction in disjunctive normal form: sets of trigrams, of which one must be held whole."""
    out = frozenset().union(*queries)
    return ANY if frozenset() in out or len(out) > 4 * MOST_STRINGS else frozenset(x for x in out if not any(y < x for y in out))


def _both(a: frozenset, b: frozenset) -> frozenset:
    if len(a) * len(b) > 4 * MOST_STRINGS:
        return a if b == ANY or (a != ANY and len(a) <= len(b)) else b
    return _either([frozenset({x | y}) for x in a for y in b])


def _of(strings: set[str]) -> frozenset:
    parts = [s.encode() for s in strings]
    return _either([frozenset({frozenset(s[i : i + 3] for i in range(len(s) - 2))}) for s in parts]) if parts else ANY


def _walk(parsed, fold) -> tuple[set[str], frozenset]:
    """The strings with which a match of the part ends or, if it has none of that kind, the empty one; and the query that the rest satisfies."""
    done, run = ANY, {""}
    for op, arg in parsed:
        exact, query = _one(op, arg, fold)
        joined = {a + b for a in run for b in exact} if exact is not None and len(run) * len(exact) <= MOST_STRINGS else None
        if joined is None:
            done = _both(_both(done, _of(run)), query)
            run = {""} if exact is None else set(exact)
        else:
            run = joined
    return run, done


def _one(op, arg, fold) -> tuple[set[str] | None, frozenset]:
    if op is sre.LITERAL:
        return {fold(chr(arg))}, ANY
    if op is sre.IN and len(arg) <= 8 and all(k is sre.LITERAL for k, _ in arg):
        return {fold(chr(c)) for _, c in arg}, ANY
    if op is sre.BRANCH:
        return _alternatives([_part(p, fold) for p in arg[1]])
    if op is sre.SUBPATTERN:
        return _part(arg[3], fold)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, part = arg
        exact, query = _part(part, fold)
        if most == 1 and exact is not None:
            return exact | ({""} if not least else set()), ANY
        if not least:
            return None, ANY
        return None, _both(query, _of(exact)) if exact is not None else query
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, ANY
    return None, ANY


def _alternatives(parts) -> tuple[set[str] | None, frozenset]:
    if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST_STRINGS:
        return set().union(*(e for e, _ in parts)), ANY
    return None, _either([q if e is None else _both(q, _of(e)) for e, q in parts])


def _part(parsed, fold) -> tuple[set[str] | None, frozenset]:
    """As _walk, but with the strings only if the part is exact as a whole."""
    exact = {""}
    for op, arg in parsed:
        one, _ = _one(op, arg, fold)
        exact = {a + b for a in exact for b in one} if one is not None and len(exact) * len(one) <= MOST_STRINGS else None
        if exact is None:
            break
    if exact is not None:
        return exact, ANY
    run, done = _walk(parsed, fold)
    return None, _both(done, _of(run))


def _lower(char: str) -> str:
    return char.lower() if char.isascii() else char


def trigram_query(pattern: str) -> frozenset:
    """Sets of lower-case trigrams (bytes), of which every match holds one set whole; {{}} if nothing is mandatory."""
    exact, query = _part(parser.parse(pattern), _lower)
    return _of(exact) if exact is not None else query


def wanted(queries: tuple[frozenset, ...]) -> tuple[dict[bytes, int], np.ndarray]:
    """The trigrams that any of the queries asks for, numbered, and a table from a trigram's 24 bits to its number + 1, or 0."""
    number = {t: k for k, t in enumerate(sorted({t for q in queries for x in q for t in x}))}
    table = np.zeros(1 << 24, np.uint16)
    for t, k in number.items():
        table[int.from_bytes(t, "big")] = k + 1
    return number, table


class BatchIndex:
    """The inverted index of a batch of texts: for each wanted trigram the sorted places of the texts that hold it."""

    def __init__(self, texts: pa.Array, number: dict[bytes, int], table: np.ndarray):
        data, offsets = column_bytes(texts)
        self.number, self.size = number, len(texts)
        low = lowered(data)
        hit, own = [], []
        for at in range(0, max(0, len(low) - 2), 1 << 22):
            part = low[at : at + (1 << 22) + 2].astype(np.uint32)
            codes = table[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            found = np.flatnonzero(codes)
            hit.append(found + at)
            own.append(codes[found])
        hit, code = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hit, own))
        text = np.searchsorted(offsets, hit, side="right") - 1
        inside = hit + 3 <= offsets[text + 1]
        pairs = np.unique((code[inside].astype(np.int64) - 1) * self.size + text[inside])
        self.texts = pairs % max(1, self.size)
        self.borders = np.searchsorted(pairs, np.arange(len(number) + 1) * self.size)

    def holding(self, trigram: bytes) -> np.ndarray:
        k = self.number[trigram]
        return self.texts[self.borders[k] : self.borders[k + 1]]

    def candidates(self, query: frozenset) -> np.ndarray:
        found = []
        for trigrams in query:
            lists = sorted((self.holding(t) for t in trigrams), key=len)
            own = lists[0] if lists else np.arange(self.size)
            for more in lists[1:]:
                own = np.intersect1d(own, more, assume_unique=True)
            found.append(own)
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def find(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text (start, place of the rule, end), sorted."""
    patterns = tuple(r.pattern for r in rules)
    queries, number, table = once(("secrets", patterns), lambda: (q := tuple(map(trigram_query, patterns)), *wanted(q)))
    index, out, strings = BatchIndex(texts, number, table), [[] for _ in range(len(texts))], texts.to_pylist()
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        for i in index.candidates(query).tolist():
            out[i] += [(a, k, b) for a, b in rule.spans(strings[i])]
    for spans in out:
        spans.sort()
    return out


def redact(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, k, end = spans[i]
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"<{rules[k].kind}>"]
        at = end
    return "".join([*out, text[at:]])


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = MORE) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, SHA-256 of the base spans, and all spans as kind:start:end by start."""
    rules = BASE + tuple(r for r in rules if r not in BASE)
    kinds, base = [r.kind for r in rules], len(BASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = find(batch.column(1).fill_null(""), rules)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        *(pa.array([sum(s[1] == k for s in x) for x in found], pa.int64()) for k in range(base)),
                        pa.array([hashlib.sha256(",".join([f"{kinds[k]}:{a}:{b}" for a, k, b in x if k < base]).encode()).hexdigest() for x in found]),
                        pa.array([",".join([f"{kinds[k]}:{a}:{b}" for a, k, b in x]) for x in found]),
                    ],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def redact_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows and columns of docs, with secrets in `text` replaced and `n_chars`, if there, counted anew. Null stays null."""
    schema = docs.schema
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(at_text)
                found = find(texts.fill_null(""), rules)
                columns = list(batch.columns)
                if any(found):
                    clean = [t if not x else redact(t, x, rules) for t, x in zip(texts.to_pylist(), found, strict=True)]
                    columns[at_text] = pa.array(clean, texts.type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
