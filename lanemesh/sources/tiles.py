"""A map server as a Spark data source: a partition for each tile of a box, asked with what Spark pushes down.

    spark.dataSource.register(TileSource)
    spark.read.format("maptiles").option("endpoint", url).option("box", "20.9,105.8,21.0,105.9").load()

Rows are elements as the server gives them, each with the tile it was asked for. Filters on the box of
nodes choose the tiles, and filters on highway the classes that are asked for (Spark keeps the filters too,
so what a server gives beyond them goes). A tile is asked for a bounded number of times. land() stores
answers by tile, asks only for tiles that aren't there yet, and gives all elements of the box once.
"""

from __future__ import annotations

import json
import math
import time
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lanemesh.functions.roads import ALLOWED
from lanemesh.schemas import TAGS, OsmData
from lanemesh.sources.osm import BBox, overpass_query, parse_elements

ELEMENTS = f"tile string, pos long, type string, id long, lat double, lon double, nodes array<long>, tags {TAGS}, highway string"
#: Side of a tile in degrees, tries for each, and seconds before the first further one; each wait doubles.
TILE, TRIES, WAIT = 0.05, 3, 0.5


def tiles(box: BBox, side: float = TILE) -> list[tuple[str, BBox]]:
    """Names and boxes of the tiles of a grid that a box touches."""
    south, west, north, east = box
    span = lambda a, b: range(math.floor(a / side + 1e-9), max(math.floor(a / side + 1e-9) + 1, math.ceil(b / side - 1e-9)))
    return [(f"{i}_{j}", (round(i * side, 9), round(j * side, 9), round((i + 1) * side, 9), round((j + 1) * side, 9))) for i in span(south, north) for j in span(west, east)]


class Tile(InputPartition):
    def __init__(self, name: str, box: BBox):
        super().__init__(name)
        self.name, self.box = name, box


class TileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.endpoint = options["endpoint"]
        self.box: BBox = tuple(map(float, options["box"].split(",")))
        self.side = float(options.get("tile", TILE))
        self.tries, self.wait = int(options.get("tries", TRIES)), float(options.get("wait", WAIT))
        self.skip = set(filter(None, options.get("skip", "").split(",")))
        self.kinds: tuple[str, ...] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the box and the classes from the filters; all stay with Spark as well."""
        south, west, north, east = self.box
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name == "highway" and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.kinds = tuple(k for k in self.kinds or ALLOWED if k in wanted)
            elif name == "lat" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                south = max(south, f.value)
            elif name == "lat" and isinstance(f, LessThan | LessThanOrEqual):
                north = min(north, f.value)
            elif name == "lon" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                west = max(west, f.value)
            elif name == "lon" and isinstance(f, LessThan | LessThanOrEqual):
                east = min(east, f.value)
        self.box = (south, west, north, east)
        return filters

    def partitions(self) -> list[Tile]:
        if self.box[0] > self.box[2] or self.box[1] > self.box[3]:
            return []
        return [Tile(n, b) for n, b in tiles(self.box, self.side) if n not in self.skip]

    def _ask(self, query: str) -> list[dict]:
        data = urllib.parse.urlencode({"data": query}).encode()
        for k in range(self.tries):
            try:
                with urllib.request.urlopen(self.endpoint, data, timeout=120) as answer:
                    return json.load(answer).get("elements", [])
            except (OSError, ValueError) as e:  # an answer cut short isn't JSON
                if k == self.tries - 1:
                    raise RuntimeError(f"{self.endpoint} gave no answer in {self.tries} tries: {e}") from e
                time.sleep(self.wait * 2**k)
        return []

    def read(self, partition: Tile) -> Iterator[tuple]:
        for pos, e in enumerate(self._ask(overpass_query(partition.box, self.kinds))):
            tags = {str(k): str(v) for k, v in (e.get("tags") or {}).items()}
            number = lambda k: None if e.get(k) is None else float(e[k])  # noqa: B023, E731
            yield partition.name, pos, e.get("type"), e.get("id"), number("lat"), number("lon"), e.get("nodes"), tags, tags.get("highway")


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "maptiles"

    def schema(self) -> str:
        return ELEMENTS

    def reader(self, schema) -> TileReader:
        return TileReader(dict(self.options))


def load(spark: SparkSession, endpoint: str, box: BBox, **options) -> DataFrame:
    spark.dataSource.register(TileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("maptiles").option("endpoint", endpoint).option("box", ",".join(map(str, box)))
    for k, v in options.items():
        rows = rows.option(k, v)
    return rows.load()


def landed(spark: SparkSession, path: str) -> set[str]:
    """The tiles that are stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName().partition("=")[2] for s in fs.listStatus(at) if s.isDirectory()} if fs.exists(at) else set()


def land(spark: SparkSession, endpoint: str, box: BBox, path: str, side: float = TILE, **options) -> OsmData:
    """Elements of the box, stored by tile under path; tiles that are stored aren't asked for again. Tiles without any element are asked for each time."""
    missing = [n for n, _ in tiles(box, side) if n not in landed(spark, path)]
    if missing:
        known = {n for n, _ in tiles(box, side)} - set(missing)
        load(spark, endpoint, box, tile=side, skip=",".join(sorted(known)), **options).write.mode("append").partitionBy("tile").parquet(path)
    wanted = [n for n, _ in tiles(box, side)]
    rows = spark.read.schema(ELEMENTS).parquet(path).where(F.col("tile").isin(wanted)) if landed(spark, path) else spark.createDataFrame([], ELEMENTS)
    # a way that several tiles hold counts once, in the first
    first = rows.where("type = 'way'").groupBy("id").agg(F.min(F.struct("tile", "pos")).alias("f")).select("id", "f.*")
    kept = rows.where("type != 'way'").unionByName(rows.join(first, ["id", "tile", "pos"], "left_semi"))
    # an order of the tiles that every run repeats
    place = F.xxhash64("tile").bitwiseAND(F.lit((1 << 30) - 1))
    return parse_elements(kept.select((place * (1 << 32) + F.col("pos")).alias("pos"), "type", "id", "lat", "lon", "nodes", "tags"))
