"""Stored flood zones: a log of changes that readers merge, so that writers never rewrite or lose each other's."""

from __future__ import annotations

import os
import time
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanemesh.lineage import cut
from lanemesh.operators.geocode import numbered
from lanemesh.schemas import STORED_ZONES

UPDATABLE = ("name", "type", "geometry", "severity", "is_active")
DEFAULT_SEVERITY = 5.0
CHANGE = f"op string, {STORED_ZONES}"
#: Seconds after which a writer that claimed a version and didn't write it is given up.
LEASE = 3600.0


class ZoneTable:
    """Zones in a folder. A change is appended under a version of its own, which its writer claims by a file of that name, which must not exist yet; the file holds the greatest id given out so far, so two writers never give the same one. Readers see the versions that are written whole, and merge them: each column has its latest value that isn't null, and a deleted zone stays deleted. compact() folds versions into a base."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("claims"))

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the folders of a kind that are written whole."""
        return sorted(int(n[1:]) for n in self._names(kind) if self._fs.exists(self._at(f"{kind}/{n}/_SUCCESS")))

    def _claimed(self, version: int) -> tuple[int, str]:
        """The id mark and tag that a version was claimed with."""
        stream = self._fs.open(self._at(f"claims/v{version}"))
        try:
            mark, _, tag = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").partition(",")
        finally:
            stream.close()
        return int(mark), tag

    def _latest(self) -> tuple[int, int]:
        """The greatest version claimed, and its id mark."""
        versions = [int(n[1:]) for n in self._names("claims") if n.startswith("v")]
        return (max(versions), self._claimed(max(versions))[0]) if versions else (0, 0)

    def _claim(self, new_ids: int, tag: str = "") -> tuple[int, int]:
        """A version of one's own, and the id mark before it. A claim is written aside and then given its name, which fails if another has it."""
        while True:
            version, mark = self._latest()
            aside = f"claims/_{uuid.uuid4().hex}"
            stream = self._fs.create(self._at(aside))
            stream.write(bytearray(f"{mark + new_ids},{tag}".encode()))
            stream.close()
            won = self._named(aside, f"claims/v{version + 1}")
            self._fs.delete(self._at(aside), False)
            if won:
                return version + 1, mark

    def _named(self, aside: str, name: str) -> bool:
        to = self._fs.makeQualified(self._at(name)).toUri()
        if to.getScheme() == "file":  # where a rename would replace what is there, a link doesn't
            try:
                os.link(self._fs.makeQualified(self._at(aside)).toUri().getPath(), to.getPath())
            except FileExistsError:
                return False
            return True
        return self._fs.rename(self._at(aside), self._at(name))

    def _append(self, changes: DataFrame, version: int) -> None:
        changes.write.parquet(f"{self.path}/log/v{version}")

    def _log(self, after: int, upto: int | None = None) -> DataFrame:
        versions = [v for v in self._complete("log") if v > after and (upto is None or v <= upto)]
        rows = None
        for v in versions:
            one = self.spark.read.schema(CHANGE).parquet(f"{self.path}/log/v{v}").withColumn("version", F.lit(v))
            rows = one if rows is None else rows.union(one)
        return self.spark.createDataFrame([], CHANGE).withColumn("version", F.lit(0)) if rows is None else rows

    def _merged(self, upto: int | None = None) -> DataFrame:
        bases = [b for b in self._complete("base") if upto is None or b <= upto]
        rows = self._log(bases[-1] if bases else 0, upto)
        if bases:
            base = self.spark.read.schema(STORED_ZONES).parquet(f"{self.path}/base/b{bases[-1]}")
            rows = rows.unionByName(base.withColumns({"op": F.lit("create"), "version": F.lit(0)}))
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(c)
        one = rows.groupBy("id").agg(*(last(c) for c in (*UPDATABLE, "updated_at")), F.max(F.col("op") == "create").alias("made"), F.max(F.col("op") == "delete").alias("gone"))
        return one.where("made and not gone").select("id", *UPDATABLE, "updated_at")

    def read(self, include_inactive: bool = True) -> DataFrame:
        out = self._merged()
        return out if include_inactive else active(out)

    def create(self, zones: DataFrame, now: datetime | None = None) -> list[int]:
        """Adds rows (name, geometry, optionally type, severity, is_active), and gives their ids, in the order of name and geometry."""
        rows = cut(zones)
        n = rows.count()
        version, mark = self._claim(n)
        self._append(created(rows, mark, now).withColumn("op", F.lit("create")), version)
        return list(range(mark + 1, mark + n + 1))

    def apply(self, changes: DataFrame, now: datetime | None = None, tag: str = "") -> None:
        """Changes (op update or delete, id, some of UPDATABLE), one of each zone at most; those of zones that aren't there have no effect. Changes with a tag that a version has already are left out."""
        if tag and any(self._claimed(v)[1] == tag for v in self._complete("log")):
            return
        given = lambda c: F.col(c).cast(kinds[c]) if c in changes.columns else F.lit(None).cast(kinds[c])
        kinds = {f.split(" ")[0]: f.split(" ")[1] for f in STORED_ZONES.split(", ")}
        some = F.lit(False)
        for c in UPDATABLE:
            some = some | given(c).isNotNull()
        rows = changes.select("op", F.col("id").cast("long").alias("id"), *(given(c).alias(c) for c in UPDATABLE), F.when(some, _stamp(now)).alias("updated_at"))
        rows = cut(rows.where((F.col("op") == "delete") | some))
        version, _ = self._claim(0, tag)
        self._append(rows, version)

    def update(self, zone_id: int, now: datetime | None = None, **changes) -> bool:
        """Changes some columns of a zone; None leaves one as it is. False if nothing was to change or there is no such zone."""
        changes = {k: v for k, v in changes.items() if k in UPDATABLE and v is not None}
        if not changes or self.read().where(F.col("id") == zone_id).first() is None:
            return False
        self.apply(self.spark.createDataFrame([("update", zone_id, *changes.values())], ["op", "id", *changes]), now)
        return True

    def delete(self, zone_id: int) -> bool:
        if self.read().where(F.col("id") == zone_id).first() is None:
            return False
        self.apply(self.spark.createDataFrame([("delete", zone_id)], "op string, id long"))
        return True

    def compact(self, lease: float = LEASE) -> int:
        """Folds all versions, up to the first that a writer may still be writing, into a base, and removes what the base before held. The version reached.

        A version claimed more than `lease` seconds ago and not written is closed with no changes; its writer's own attempt then fails."""
        done, reached = set(self._complete("log")), max(self._complete("base"), default=0)
        before = reached
        for v in range(reached + 1, self._latest()[0] + 1):
            if v not in done:
                made = self._fs.getFileStatus(self._at(f"claims/v{v}")).getModificationTime() / 1000
                if time.time() - made < lease:
                    break
                self._append(self.spark.createDataFrame([], CHANGE), v)
            reached = v
        if reached > before:
            self._merged(reached).write.parquet(f"{self.path}/base/b{reached}")
            # readers of the base before may still be at it: what that one held goes
            for v in [v for v in done if v <= before]:
                self._fs.delete(self._at(f"log/v{v}"), True)
            for b in self._complete("base")[:-2]:
                self._fs.delete(self._at(f"base/b{b}"), True)
        return reached


def _stamp(now: datetime | None) -> Column:
    return F.lit(now).cast("timestamp") if now else F.current_timestamp()


def active(zones: DataFrame) -> DataFrame:
    return zones.where("is_active")


def created(zones: DataFrame, mark: int, now: datetime | None = None) -> DataFrame:
    """New zones with ids after the mark and defaults filled in."""
    has = lambda c, kind, default: F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in zones.columns else F.lit(default)
    rows = zones.select("name", has("type", "string", "polygon").alias("type"), "geometry", has("severity", "double", DEFAULT_SEVERITY).alias("severity"), has("is_active", "boolean", True).alias("is_active"), _stamp(now).alias("updated_at"))
    return numbered(rows, ["name", "geometry"]).select((F.col("id") + mark).alias("id"), *UPDATABLE, "updated_at")


def patched(zones: DataFrame, patch: DataFrame, now: datetime | None = None) -> DataFrame:
    """zones with the non-null columns of the patch (id and some of UPDATABLE) put in; changed rows are stamped."""
    given = [c for c in UPDATABLE if c in patch.columns]
    p = patch.select(F.col("id").alias("pid"), *(F.col(c).alias(f"p_{c}") for c in given))
    changed = F.lit(False)
    for c in given:
        changed = changed | F.col(f"p_{c}").isNotNull()
    joined = zones.join(p, F.col("id") == F.col("pid"), "left")
    value = lambda c: F.coalesce(F.col(f"p_{c}").cast(zones.schema[c].dataType), F.col(c)).alias(c) if c in given else F.col(c)
    return joined.select("id", *(value(c) for c in UPDATABLE), F.when(changed, _stamp(now)).otherwise(F.col("updated_at")).alias("updated_at"))


def features(zones: DataFrame) -> DataFrame:
    """zone_id and a GeoJSON feature of each zone whose geometry is JSON; the penalty is its severity."""
    doc = zones.withColumn("v", F.try_parse_json("geometry")).where("v is not null")
    properties = F.to_json(F.struct("id", "name", F.lit("flood").alias("blockType"), F.col("severity").alias("penalty"), "is_active"))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), F.to_json("v"), F.lit("}"))
    return doc.select(F.col("id").alias("zone_id"), "name", F.col("severity").alias("penalty"), "is_active", feature.alias("feature"))
