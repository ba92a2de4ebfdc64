"""Reading input tables, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to remove the shuffle files of a query when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs on one machine (tests), a folder in the warehouse."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return at or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def keep(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows of df as a written table: lineage is cut, and losing an executor loses nothing. Removed as the session ends.

    Once the table is written its shuffles serve nothing, so Spark removes their files at the end of the write."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEAN_UP, before)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables that keep() wrote, once what reads them has been written itself."""
    for df in tables:
        _made.remove((df.sparkSession, df.kept_path))
        _remove(df.sparkSession, df.kept_path)


def once(key, make):
    """make()'s value, kept by this Python worker for its later tasks; the globals of functions that travel by value last for one task only."""
    kept = sys.__dict__.setdefault("_llm_once", {})
    if key not in kept:
        kept.clear()  # one value at a time: a worker serves one operator after another
        kept[key] = make()
    return kept[key]


def free() -> None:
    """Drops what once() keeps in this worker, before work that needs the memory itself."""
    sys.__dict__.get("_llm_once", {}).clear()


def forget() -> None:
    """Removes the tables that keep() wrote."""
    while _made:
        _remove(*_made.pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has gone
        pass


atexit.register(forget)
