"""License scans: ordered signature rules over the words of whole texts, with DataFrame functions alone.

A text's words are put side by side with a space at both ends of each. A rule (license_rules.py) is
tried on a text only if a keyword of it is among the text's words; its matches are leftmost and don't
overlap. A detection goes if one of an earlier rule contains its interval; detections of base rules stay.

All detections of a text are sorted by start and rule, so that whatever contains one stands before it,
at most MOST_WORDS words away: each is compared with as many before it as two blocks of MOST_WORDS
words of that text hold at most. Rows are scanned where they are read; nothing is shuffled.

Null and empty texts have no words, no labels and score 0. Repeated rows are scanned each; other
columns, whatever their names, stay in the struct `row`. An empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.license_rules import MOST_WORDS, Rule, parsed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Marks around matches; no word holds them.
OPEN, CLOSE = "\x01", "\x02"
RULE_TYPE = "array<struct<order:int,base:boolean,label:string,strength:double,keywords:array<string>,pattern:string>>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _spans(flat: Column, rule: Column) -> Column:
    """Intervals of words that the rule matches: the word that follows OPEN is its first, that before CLOSE its last."""
    tokens = F.regexp_extract_all(F.regexp_replace(flat, rule["pattern"], F.lit(f"{OPEN}$0{CLOSE}")), F.lit(f"{OPEN}? [^ ]+ {CLOSE}?"), F.lit(0))
    there = lambda mark, more: F.filter(F.transform(tokens, lambda t, i: F.when(mark(t), i + more)), lambda i: i.isNotNull())
    starts, ends = there(lambda t: F.startswith(t, F.lit(OPEN)), 0), there(lambda t: F.endswith(t, F.lit(CLOSE)), 1)
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), rule["order"].alias("order"), e.alias("end"), rule["label"].alias("label"), rule["strength"].alias("strength"), rule["base"].alias("base")))


def _crowd(found: Column) -> Column:
    """The most detections that start in two neighbouring blocks of MOST_WORDS words."""
    block = lambda d: F.floor(d["start"] / MOST_WORDS).cast("int")
    none = F.lit(0)
    zero = F.struct(F.lit(-1).alias("block"), none.alias("own"), none.alias("before"), none.alias("most"))

    def step(a, d):
        same, after = block(d) == a["block"], block(d) == a["block"] + 1
        own = F.when(same, a["own"] + 1).otherwise(1)
        before = F.when(same, a["before"]).when(after, a["own"]).otherwise(0)
        return F.struct(block(d).alias("block"), own.alias("own"), before.alias("before"), F.greatest(a["most"], own + before).alias("most"))

    return F.aggregate(found, zero, step, lambda a: a["most"])


def _kept(found: Column, crowd: Column) -> Column:
    def hidden(d, i):
        before = F.slice(found, F.greatest(i - crowd, F.lit(0)) + 1, F.least(i, crowd))
        return F.exists(before, lambda o: (o["end"] >= d["end"]) & (o["order"] < d["order"]))

    return F.filter(found, lambda d, i: d["base"] | ~hidden(d, i))


def detect(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """row (the input's columns), n_words, found (all detections) and kept (those not contained in one of an earlier rule): arrays of start, order, end, label, strength, base; words count from 0, ends are exclusive."""
    rules = parsed() if rules is None else rules
    keywords = sorted({k for r in rules for k in r.keyword.split("/")})
    listed = F.from_json(F.lit(json.dumps([r._asdict() | {"keywords": r.keyword.split("/")} for r in rules])), RULE_TYPE)
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), words(F.col("text")).alias("words"))
    out = out.withColumn("at", F.array_intersect("words", F.array(*map(F.lit, keywords))))
    some = F.size("at") > 0
    out = out.select("row", F.size("words").cast("long").alias("n_words"), "at", F.when(some, F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).alias("flat"))
    gated = F.when(some, F.filter(listed, lambda r: F.arrays_overlap(r["keywords"], F.col("at")) & F.rlike(F.col("flat"), r["pattern"])))
    out = out.select("row", "n_words", "flat", gated.alias("gated"))
    found = F.array_sort(F.flatten(F.transform("gated", lambda r: _spans(F.col("flat"), r))))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,order:int,end:int,label:string,strength:double,base:boolean>>")
    out = out.select("row", "n_words", F.coalesce(found, none).alias("found"))
    out = out.withColumn("crowd", _crowd(F.col("found")))
    return out.select("row", "n_words", "found", _kept(F.col("found"), F.col("crowd")).alias("kept"))


def labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, places of the base phrases, labels, and the strength of the strongest detection kept as its score."""
    out = detect(docs.select("doc_id", "text")).withColumn("base", F.filter("found", lambda d: d["base"]))
    starts = F.transform("base", lambda d: d["start"])
    return out.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("kept")).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["strength"])), F.lit(0.0)).alias("score"),
    )


def labelled_documents(docs: DataFrame) -> DataFrame:
    """One row per detection kept: the document's columns in `row`, then label, strength, start and end in words."""
    return detect(docs).select("row", F.explode("kept").alias("d")).select("row", "d.label", "d.strength", "d.start", "d.end")


def scan_sql(rules: list[Rule] | None = None) -> str:
    """DuckDB SQL with the rows of scan_documents(): starts by the words of the pieces between matches, containment by a self-join."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({r.order}, {str(r.base).lower()}, {quote(r.label)}, {r.strength}::DOUBLE, {quote(r.keyword)}, {quote(r.pattern)})" for r in rules or parsed())
    return rf"""
WITH rules(ord, base, label, strength, keyword, pattern) AS (VALUES
{values}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
flat AS (SELECT rid, words, CASE WHEN len(words) > 0 THEN ' ' || array_to_string(words, '  ') || ' ' ELSE '' END AS t FROM docs),
hit AS (SELECT rid, t, r.* FROM flat JOIN rules r ON list_has_any(words, string_split(keyword, '/')) AND regexp_matches(t, pattern)),
cuts AS (SELECT *, string_split_regex(t, pattern) AS parts, regexp_extract_all(t, pattern) AS found FROM hit),
each AS (SELECT rid, ord, base, label, strength, unnest(range(1, len(found) + 1)) AS k, parts, found FROM cuts),
sized AS (SELECT rid, ord, base, label, strength, k, (len(parts[k]) - len(replace(parts[k], ' ', ''))) // 2 AS gap, (len(found[k]) - len(replace(found[k], ' ', ''))) // 2 AS own FROM each),
ends AS (SELECT *, CAST(sum(gap + own) OVER (PARTITION BY rid, ord ORDER BY k) AS BIGINT) AS e FROM sized),
span AS (SELECT *, e - own AS s FROM ends),
kept AS (SELECT * FROM span d WHERE base OR NOT EXISTS (SELECT 1 FROM span o WHERE o.rid = d.rid AND o.ord < d.ord AND o.s <= d.s AND o.e >= d.e)),
base AS (SELECT rid, count(*) AS n, min(s) AS a, max(s) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM span WHERE base GROUP BY rid),
own AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS names, max(strength) AS score FROM kept GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.a AS first_word, b.z AS last_word,
  coalesce(b.names, '') AS base_labels, coalesce(o.names, '') AS labels, coalesce(o.score, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN base b USING (rid) LEFT JOIN own o USING (rid)
"""
