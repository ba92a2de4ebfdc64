"""Written tables: lineage is cut in iterative plans, and indexes are stored by their keys."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}

#: Largest side, in bytes as Spark judges it, that is sent through the driver to all tasks while a table is written: rounds have many joins, each with its own.
SENT = 1 << 20
THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@contextlib.contextmanager
def little_sent(spark: SparkSession) -> Iterator[None]:
    """Broadcasts of no more than SENT bytes, or less if the session says so."""
    before = spark.conf.get(THRESHOLD)
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() <= SENT:
        yield
        return
    spark.conf.set(THRESHOLD, str(SENT))
    try:
        yield
    finally:
        spark.conf.set(THRESHOLD, before)


def new_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder all executors share: spark.checkpoint.dir; where all runs on one machine, one in the warehouse will do."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_rounds"
    path = f"{folder}/{kind}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """df as a written table, read again: rounds neither recompute earlier ones nor lose them with an executor."""
    spark = df.sparkSession
    path = new_path(spark, "round")
    with little_sent(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str, bloom: str | None = None) -> DataFrame:
    """df as a written table in buckets by keys, sorted in each: joins on the keys don't shuffle it. With `bloom`, files have a Bloom filter of that column."""
    spark = df.sparkSession
    path = new_path(spark, "buckets")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "lanemesh_" + path.rsplit("-", 1)[1]
    writer = df.repartition(n, *keys).sortWithinPartitions(*keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path)
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
    with little_sent(spark):
        writer.saveAsTable(name)
    return spark.table(name)


def drop(df: DataFrame) -> None:
    """Removes the tables of cut() or bucketed() that df reads, once nothing else will read them."""
    for file in df.inputFiles()[:1]:
        for path in [p for p in _written if p.rsplit("/", 1)[1] in file]:
            _remove(path)


def _remove(path: str) -> None:
    spark = _written.pop(path)
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if "/buckets-" in path:
            spark.sql(f"DROP TABLE IF EXISTS lanemesh_{path.rsplit('-', 1)[1]}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has gone
        pass


def sweep() -> None:
    """Removes all tables that are left."""
    for path in list(_written):
        _remove(path)


atexit.register(sweep)
