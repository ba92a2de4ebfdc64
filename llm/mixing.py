"""Mixing sources to target weights: a time-varying curriculum, with DataFrame functions alone.

Each source takes `target` words of the mix: its documents, in an order fixed by MD5, form a stream
that repeats, and its first `target` words are taken. A source's schedule, piecewise linear over
training time 0 to 1, is integrated; a document's place in its stream is turned into a training
time by the inverse of that integral, and documents are range-sorted by it.

Prefix sums are taken in two steps, within and over the (source, bucket of the order) groups, so no
source, however large, meets in one task. A table has one row per source and bucket, 4096 buckets
at most, where sums over a source are needed.

Null text: size 0. Null source: a source of its own, sorted last. Documents of size 0 take no words
and have no position. Repeated rows count each, and stand next to each other in the stream. Empty
tables give empty results. Columns other than those named here stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed by the contract: weights of the sources in order, repeating; most repeats of a document.
WEIGHTS = (5, 2, 1)
MOST = 3
#: How far the default schedule leaves an even mix: the last source by order gains, the first loses.
TILT = 0.8


def _with_keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumns(
        {
            "size_": F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long"),
            "skey_": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("~")),
            "key_": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary")),
        }
    )
    return out.withColumn("bucket_", F.substring("key_", 1, 3))


def source_targets(sums: DataFrame) -> DataFrame:
    """skey_, source_size and its target of the total, given skey_ and size_ sums: the level that fills all sources by weight, none above MOST times its size."""
    one = W.partitionBy(F.lit(0)).orderBy("skey_").rowsBetween(W.unboundedPreceding, W.currentRow)
    all_rows = W.partitionBy(F.lit(0))
    n = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("skey_")) - 1
    out = sums.groupBy("skey_").agg(F.sum("size_").alias("source_size"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (n % len(WEIGHTS) + 1).cast("int"))
    out = out.withColumns({"weight_": weight, "place_": n.cast("double"), "sources_": F.count("*").over(all_rows)})
    by_ratio = W.partitionBy(F.lit(0)).orderBy(MOST * F.col("source_size") / F.col("weight_"), "skey_").rowsBetween(W.unboundedPreceding, -1)
    full = F.coalesce(F.sum(MOST * F.col("source_size")).over(by_ratio), F.lit(0))
    gone = F.coalesce(F.sum("weight_").over(by_ratio), F.lit(0.0))
    level = (F.sum("source_size").over(all_rows) - full) / (F.sum("weight_").over(all_rows) - gone)
    out = out.withColumn("level_", level).withColumn("level_", F.max("level_").over(all_rows))
    out = out.withColumn("target", F.least((MOST * F.col("source_size")).cast("double"), F.col("level_") * F.col("weight_")))
    out = out.withColumn("words_", F.floor(F.col("target") + 0.5).cast("long"))
    rank = F.when(F.col("sources_") > 1, F.col("place_") / (F.col("sources_") - 1)).otherwise(F.lit(0.0))
    out = out.withColumn("rank_", rank)
    mean = F.coalesce(F.sum(F.col("rank_") * F.col("words_")).over(all_rows) / F.nullif(F.sum("words_").over(all_rows), F.lit(0)), F.lit(0.0))
    tilt = TILT * (F.col("rank_") - mean)
    return out.withColumn("schedule_", F.array(1 - tilt, F.lit(1.0), 1 + tilt)).select("skey_", "source_size", "target", "words_", "schedule_")


def training_time(share: Column, weights: Column, knots: tuple[float, ...]) -> Column:
    """When a source has met the given share, 0 to 1, of its demand: weights are its rates at the knots, linear between them."""
    areas = [(weights[i] + weights[i + 1]) / 2 * (b - a) for i, (a, b) in enumerate(zip(knots, knots[1:], strict=False))]
    total = sum(areas[1:], areas[0])
    wanted, done, out = share * total, F.lit(0.0), None
    for i, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
        left, slope = wanted - done, (weights[i + 1] - weights[i]) / (b - a)
        root = weights[i] + F.sqrt(F.greatest(weights[i] * weights[i] + 2 * slope * left, F.lit(0.0)))
        time = F.when(left <= 0, F.lit(a)).otherwise(F.least(a + 2 * left / root, F.lit(b)))
        done = done + areas[i]
        if i < len(knots) - 2:
            out = (F if out is None else out).when(wanted <= done, time)
        else:
            out = time if out is None else out.otherwise(time)
    return out


def assign(docs: DataFrame, schedules: DataFrame | None = None, knots: tuple[float, ...] = (0.0, 0.5, 1.0)) -> DataFrame:
    """docs with size, source_size, target, taken, and positions: the training time at which each taken repeat starts.

    schedules: source, and weights (rates at the knots); sources without a row there keep the default."""
    keyed = _with_keys(docs)
    sums = keyed.groupBy("skey_", "bucket_").agg(F.sum("size_").alias("size_"))
    before = F.coalesce(F.sum("size_").over(W.partitionBy("skey_").orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    targets = source_targets(sums)
    if schedules is not None:
        own = schedules.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("~")).alias("skey_"), F.col("weights").cast("array<double>").alias("own_"))
        targets = targets.join(own.dropDuplicates(["skey_"]), "skey_", "left").withColumn("schedule_", F.coalesce("own_", "schedule_")).drop("own_")
    offsets = sums.select("skey_", "bucket_", before.alias("offset_")).join(targets, "skey_")
    within = W.partitionBy("skey_", "bucket_").orderBy("key_").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = keyed.withColumn("start_", F.sum("size_").over(within) - F.col("size_")).join(offsets, ["skey_", "bucket_"])
    out = out.withColumn("start_", F.col("start_") + F.col("offset_"))
    starts = [F.col("start_") + p * F.col("source_size") for p in range(MOST)]
    parts = [F.greatest(F.lit(0), F.least(F.col("size_"), F.col("words_") - s)) for s in starts]
    times = F.array(*(F.when(part > 0, training_time(s / F.col("words_"), F.col("schedule_"), knots)) for part, s in zip(parts, starts, strict=True)))
    out = out.withColumns({"taken": sum(parts[1:], parts[0]).cast("long"), "parts_": F.array(*parts), "positions": F.filter(times, lambda t: t.isNotNull())})
    return out.withColumn("size", F.col("size_"))


def mix_table(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, position (of its first repeat; null if none), range-sorted by position."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    out = assign(slim).select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 9).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs as the mix trains on them: one row per repeat, of which half the words or more are taken, sorted by training time. Same columns."""
    out = assign(docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_")))
    repeats = F.filter("parts_", lambda x: 2 * x >= F.col("size_"))
    out = out.where("size_ > 0").withColumn("positions", F.slice("positions", F.lit(1), F.size(repeats)))
    return out.select("row_", F.explode("positions").alias("position_"), "key_").orderBy("position_", "key_").select("row_.*")


MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         coalesce('s' || source, '~') AS skey,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
src AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY skey) - 1 AS place FROM docs GROUP BY skey),
wsrc AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, count(*) OVER () AS sources FROM src),
lev AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER r, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS lv
  FROM wsrc WINDOW r AS (ORDER BY 3 * source_size / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (SELECT *, least(CAST(3 * source_size AS DOUBLE), max(lv) OVER () * weight) AS target,
  CASE WHEN sources > 1 THEN CAST(place AS DOUBLE) / (sources - 1) ELSE 0.0 END AS rk FROM lev),
sched AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words FROM tgt),
tilt AS (SELECT *, 0.8::DOUBLE * (rk - coalesce(sum(rk * words) OVER () / nullif(sum(words) OVER (), 0), 0.0)) AS k FROM sched),
placed AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.words, t.k,
  CAST(sum(d.size) OVER (PARTITION BY d.skey ORDER BY d.key ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start FROM docs d JOIN tilt t USING (skey)),
timed AS (SELECT *, start / CAST(nullif(words, 0) AS DOUBLE) AS q, ((1 - k) + 1.0) / 2 * 0.5 AS a1 FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(greatest(0, least(size, words - start)) + greatest(0, least(size, words - start - source_size)) + greatest(0, least(size, words - start - 2 * source_size)) AS BIGINT) AS taken,
  round(CASE WHEN least(size, words - start) <= 0 THEN NULL
       WHEN q <= 0 THEN 0.0
       WHEN q <= a1 THEN least(2 * q / ((1 - k) + sqrt(greatest((1 - k) * (1 - k) + 2 * (2 * k) * q, 0.0))), 0.5)
       ELSE least(0.5 + 2 * (q - a1) / (1.0 + sqrt(greatest(1.0 + 2 * (2 * k) * (q - a1), 0.0))), 1.0) END, 9) AS position
FROM timed
"""
