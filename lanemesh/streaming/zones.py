"""Zone changes as a stream: the latest change of each zone, applied to the stored table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lanemesh.operators.zones import ZoneTable

CHANGES = "op string, id long, name string, type string, geometry string, severity double, is_active boolean, ts timestamp"


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each zone."""
    rest = [c for c in changes.columns if c != "id"]
    return changes.groupBy("id").agg(F.max_by(F.struct(*rest), "ts").alias("c")).select("id", "c.*")


def apply_changes(table: ZoneTable, changes: DataFrame, tag: str = "") -> None:
    """Appends the last change of each zone: updates (op update) and deletions (op delete)."""
    table.apply(latest(changes).where("op in ('update', 'delete')"), tag=tag)


def follow(changes: DataFrame, table: ZoneTable, checkpoint: str) -> StreamingQuery:
    """Applies a stream of CHANGES as it comes; ends once all that is there has been applied. A batch that is repeated after a failure is known by its number, and left out."""
    return changes.writeStream.foreachBatch(lambda batch, n: apply_changes(table, batch, f"{checkpoint}#{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_counts(changes: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Changes by window and kind; rows later than `late` are left out."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", window), "op").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "op", "n")
