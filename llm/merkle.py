"""WARC fixity audit with Merkle trees.

Each record of an archive file is hashed; records are grouped by fixed ranges of their byte offset,
ranges by FAN_OUT wider ranges, and so on to the file, then files likewise to one root per replica.
Two replicas' roots are compared, and only below nodes that differ are the children compared, down
to the ranges and then the records that are damaged.

A record belongs to the range that holds its first byte, so a group is bounded by the range's bytes
and no window or sort over a file is needed. Records that repeat at one offset are counted.

Null payload: hashed as null, apart from the empty one. Null file_no or offset: file -1 and offset -1;
records without an offset are dealt to UNPLACED ranges by their hash, and compared one by one. An
empty replica has no nodes, and all records of the other are then missing or extra. A payload is
held by one task, alone, however long. Columns other than file_no, offset and payload are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.tables import keep

RANGE_BYTES = 1 << 16
FAN_OUT = 16
#: Ranges, numbered from -1 downwards, that records without an offset are dealt to.
UNPLACED = 4096
#: Pages of one archive file that pages_archive() writes.
PAGES_A_FILE = 256


def digests(records: DataFrame, *columns: str) -> DataFrame:
    """These columns of records with length and hash of their payloads."""
    payload = F.col("payload").cast("binary")
    return records.select(*columns, F.coalesce(F.length(payload), F.lit(-1)).cast("long").alias("length"), F.when(payload.isNull(), F.lit("null")).otherwise(F.sha2(payload, 256)).alias("hash"))


def counted(records: DataFrame) -> DataFrame:
    """file_no, offset, length, hash and copies of each different record, given the first four."""
    at = [F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ("file_no", "offset")]
    return records.groupBy(*at, "length", "hash").agg(F.count("*").alias("copies"))


def hashed(records: DataFrame) -> DataFrame:
    """file_no, offset, length, hash and copies of each different record. file_no numbers the files by a column of that name."""
    return counted(digests(records, "file_no", "offset"))


def _place(range_bytes: int) -> Column:
    """The number of a record's range."""
    return F.when(F.col("offset") < 0, -1 - F.pmod(F.xxhash64("hash"), F.lit(UNPLACED))).otherwise(F.expr(f"offset div {range_bytes}"))


def _node(children: Column, level: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{level}:"), F.concat_ws(",", children)).cast("binary"), 256)


def range_nodes(records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Level 0: file_no, place (offset // range_bytes) and hash of the records in that range, by offset."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, "0"), "length", "hash", "copies")))
    return records.groupBy("file_no", _place(range_bytes).alias("place")).agg(_node(parts, 0).alias("hash"))


def _above(nodes: DataFrame, keys: list[Column], place: str, level: int, fan_out: int) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.concat_ws(":", F.lpad((F.col(place) % fan_out).cast("string"), 4, "0"), "hash")))
    return nodes.groupBy(*keys, F.expr(f"{place} div {fan_out}").alias(place)).agg(_node(parts, level).alias("hash"))


def trees(records: DataFrame, name: str, depths: tuple[int, int], range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Written tables of nodes (file_no, place, hash) from the ranges up to one root. depths: levels within a file, and over files."""
    levels = [keep(range_nodes(records, range_bytes), f"{name}0")]
    for k in range(depths[0]):
        levels.append(keep(_above(levels[-1], ["file_no"], "place", k + 1, fan_out), f"{name}{k + 1}"))
    for k in range(depths[1]):
        levels.append(keep(_above(levels[-1], ["place"], "file_no", depths[0] + k + 1, fan_out), f"{name}{depths[0] + k + 1}"))
    return levels


def depths(records: DataFrame, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT) -> tuple[int, int]:
    """How many levels join all ranges of the longest file, and all files, into one node. -1 // n is 0 in SQL, so a null key needs none."""
    at = records.agg(F.max("offset"), F.max("file_no"), F.min("offset")).first()
    out = []
    for n in (max((at[0] or 0) // range_bytes, UNPLACED if (at[2] or 0) < 0 else 0), at[1] or 0):
        k = 0
        while n > 0:
            n, k = n // fan_out, k + 1
        out.append(k)
    return out[0], max(out[1], 1)


def audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """Where replicas, given as file_no, offset, payload, differ: a row per damaged record with its status: altered, missing, extra (from the left's view) or copies."""
    a, b = keep(hashed(left), "merkle-a"), keep(hashed(right), "merkle-b")
    return audit_hashed(a, b, range_bytes, fan_out)


def audit_hashed(a: DataFrame, b: DataFrame, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """As audit, from tables that hashed() has made and that can be read again."""
    most = [max(x) for x in zip(depths(a, range_bytes, fan_out), depths(b, range_bytes, fan_out), strict=True)]
    ta, tb = trees(a, "merkle-ta", tuple(most), range_bytes, fan_out), trees(b, "merkle-tb", tuple(most), range_bytes, fan_out)
    suspects: DataFrame | None = None
    for level in range(len(ta) - 1, -1, -1):
        x, y = ta[level], tb[level]
        if suspects is not None:  # descend below mismatching nodes only
            up = "file_no" if level >= most[0] else "place"
            parent = lambda t, up=up: t.withColumn("up_", F.expr(f"{up} div {fan_out}")).join(suspects.withColumnRenamed(up, "up_"), ["up_", "place" if up == "file_no" else "file_no"], "left_semi").drop("up_")  # noqa: B023, E731
            x, y = parent(x), parent(y)
        pair = x.join(y.withColumnRenamed("hash", "other_"), ["file_no", "place"], "full_outer")
        suspects = pair.where(~F.col("hash").eqNullSafe(F.col("other_"))).select("file_no", "place")
        suspects = keep(suspects, f"merkle-s{level}")
    under = lambda t: t.withColumn("place", _place(range_bytes)).join(suspects, ["file_no", "place"], "left_semi")
    at = ["file_no", "offset", F.when(F.col("offset") < 0, F.col("hash")).otherwise("").alias("alone")]
    x = under(a).groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("hash", "length", "copies"))).alias("l"))
    y = under(b).groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("hash", "length", "copies"))).alias("r"))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when(F.col("l.hash") == F.col("r.hash"), "copies").otherwise("altered")
    found = x.join(y, ["file_no", "offset", "alone"], "full_outer").where(~F.col("l").eqNullSafe(F.col("r")))
    return found.select("file_no", "offset", status.alias("status"), F.get("l", F.lit(0))["length"].alias("length"), F.get("l", F.lit(0))["hash"].alias("expected"), F.get("r", F.lit(0))["hash"].alias("found"))


def root(nodes: list[DataFrame]) -> str | None:
    """The hash of the last level's only node."""
    row = nodes[-1].select("hash").first()
    return row and row[0]


def page_records(pages: DataFrame) -> DataFrame:
    """WARC response records of web pages: page_id, file_no, payload. A file holds the pages of PAGES_A_FILE ids; rows without an id go to files by hash."""
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    record = F.concat(head, html, F.lit("\r\n\r\n")).cast("binary")
    file_no = F.coalesce(F.expr(f"cast(page_id as bigint) div {PAGES_A_FILE}"), F.pmod(F.xxhash64(url, html), F.lit(1 << 20)))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), file_no.alias("file_no"), record.alias("payload"))


def _local_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the same file before each record in one sorted partition, and the record's own."""
    file, done = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        files, sizes = batch.column(1).to_numpy(), pc.binary_length(batch.column(2)).to_numpy().astype(np.int64)
        before = np.cumsum(sizes) - sizes
        first = np.flatnonzero(np.insert(files[1:] != files[:-1], 0, True))
        which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(files))))
        begin = -before[first]
        if files[0] == file:
            begin[0] += done
        local = before + begin[which]
        file, done = files[-1], int(local[-1] + sizes[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(local), pa.array(sizes)], ["page_id", "file_no", "payload", "pid", "local", "length"])


def pages_archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A written replica of the pages' records, in a file by id and hash: page_id, file_no, payload, pid, local (offset in that part of the file), length; and the offset at which each part (file_no, pid) begins.

    Records are sorted by range and offsets summed in two steps, within and over the partitions a file
    lies in: rows of one id, and equal rows, are dealt out like others."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["file_no", "page_id", "hash_", "row_"]
    rows = page_records(pages).withColumns({"hash_": F.sha2("payload", 256), "row_": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("page_id", "file_no", "payload", F.spark_partition_id().alias("pid"))
    rows = keep(rows.mapInArrow(_local_offsets, "page_id long, file_no long, payload binary, pid int, local long, length long"), "merkle-archive", "zstd")
    sums = rows.groupBy("file_no", "pid").agg(F.sum("length").alias("bytes"))
    earlier = W.partitionBy("file_no").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    begins = sums.select("file_no", "pid", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("begin"))
    return rows, begins


def placed(rows: DataFrame, begins: DataFrame) -> DataFrame:
    """rows with their offset in the file."""
    return rows.join(begins, ["file_no", "pid"]).withColumn("offset", F.col("begin") + F.col("local")).drop("begin", "local", "pid")


def damaged(records: DataFrame) -> DataFrame:
    """A replica with planted damage, by page_id: of every 97th record the first byte altered, every 331st lost, every 499th written twice."""
    page = F.col("page_id")
    out = records.where(~((page % 331 == 5).eqNullSafe(True)))
    out = out.withColumn("payload", F.when(page % 97 == 3, F.expr("concat(cast('X' as binary), substring(payload, 2))")).otherwise(F.col("payload")))
    return out.withColumn("again_", F.explode(F.when(page % 499 == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("again_")


def audit_pages(pages: DataFrame) -> DataFrame:
    """The audit of the pages' archive against a second one, written with the damage that damaged() makes; with page_id. Both are read back and hashed."""
    first, begins = pages_archive(pages)
    second = keep(damaged(first).select("file_no", "pid", "local", "payload"), "merkle-second", "zstd")
    # payloads are hashed where they are read: what is joined and shuffled is slim
    a, b = (keep(counted(placed(digests(x, "file_no", "pid", "local"), begins)), f"merkle-{n}") for x, n in ((first, "a"), (second, "b")))
    pages_at = placed(first.select("file_no", "pid", "local", "page_id"), begins)
    return audit_hashed(a, b).join(pages_at, ["file_no", "offset"], "left").select("page_id", "file_no", "offset", "length", "status", "expected", "found")


PAGES_SQL = r"""
WITH rec AS (SELECT page_id, page_id // 256 AS file_no,
   'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
   || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS payload FROM pages),
h AS (SELECT page_id, file_no, payload, CAST(strlen(payload) AS BIGINT) AS length, sha256(payload) AS expected FROM rec),
o AS (SELECT *, CAST(sum(length) OVER (PARTITION BY file_no ORDER BY page_id, expected ROWS UNBOUNDED PRECEDING) AS BIGINT) - length AS "offset" FROM h)
SELECT page_id, file_no, "offset", length,
  CASE WHEN page_id % 331 = 5 THEN 'missing' WHEN page_id % 97 = 3 THEN 'altered' ELSE 'copies' END AS status, expected,
  CASE WHEN page_id % 331 = 5 THEN NULL WHEN page_id % 97 = 3 THEN sha256('X' || substr(payload, 2)) ELSE expected END AS found
FROM o WHERE page_id % 331 = 5 OR page_id % 97 = 3 OR page_id % 499 = 7
"""
