"""Joins by place: boxes that meet, over a hierarchy of cells; and keys dealt out where one has many rows.

A box belongs to the level whose cells are as large as it is, and to few of them there, however large it is
or small. A large box meets a small one in the cell that the small one's ancestor at the large one's level
has. So each side is laid out over its own level and over the coarser levels that the other side has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanemesh.lineage import cut

#: Side of the cells of level 0, in degrees; each level halves it.
ROOT, DEEPEST = 512.0, 24
#: Rows of a key on either side that one task takes.
LOAD = 20_000
SIDES = ("minx", "maxx", "miny", "maxy")
CELL = ["kind", "at", "cx", "cy"]


def dealt(left: DataFrame, right: DataFrame, keys: list[str], most_left: int, most_right: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """left and right, and the keys by which each pair of rows with equal keys meets once: a key with more rows than `most_` on a side is dealt out there, and its rows of the other side go to every deal."""
    count = lambda rows, most, name: rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias(name)).where(F.col(name) > 1)
    hot = cut(count(left, most_left, "deals_l").join(count(right, most_right, "deals_r"), keys, "full"))

    def deal(rows: DataFrame, own: str, other: str) -> DataFrame:
        names = rows.columns
        rows = rows.join(hot, keys, "left").withColumns({f"deals_{s}": F.coalesce(f"deals_{s}", F.lit(1)) for s in "lr"})
        rows = rows.withColumn(f"deal_{own}", F.pmod(F.xxhash64(*names), F.col(f"deals_{own}")).cast("int"))
        return rows.withColumn(f"deal_{other}", F.explode(F.sequence(F.lit(0), F.col(f"deals_{other}") - 1))).drop("deals_l", "deals_r")

    return deal(left, "l", "r"), deal(right, "r", "l"), [*keys, "deal_l", "deal_r"]


def level(minx: Column, maxx: Column, miny: Column, maxy: Column) -> Column:
    """The deepest level whose cells are no smaller than the box."""
    size = F.greatest(maxx - minx, maxy - miny, F.lit(ROOT / 2**DEEPEST))
    return F.greatest(F.floor(F.log2(F.lit(ROOT) / size)).cast("int"), F.lit(0))


def side(at: Column) -> Column:
    return F.lit(ROOT) / F.pow(F.lit(2.0), at)


def _cells(rows: DataFrame, at: Column, kind: str, prefix: str = "") -> DataFrame:
    """rows once for each cell that their box touches at the levels `at` (an array)."""
    low, high = ((F.col(f"{prefix}min{c}"), F.col(f"{prefix}max{c}")) for c in "xy")
    rows = rows.withColumns({"kind": F.lit(kind), "at": F.explode(at)})
    for name, (a, b) in (("cx", low), ("cy", high)):
        rows = rows.withColumn(name, F.explode(F.sequence(F.floor(a / side(F.col("at"))), F.floor(b / side(F.col("at"))))))
    return rows


def meeting(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Pairs of rows whose boxes (SIDES) meet, each once; the box of zones is named zminx and so on.

    Zones with no more than LOAD cells at all levels are sent to the rows as boxes, which then aren't shuffled, counted or dealt out."""
    rows = rows.withColumn("level", level(*(F.col(c) for c in SIDES)))
    zones = cut(zones.withColumnsRenamed({c: f"z{c}" for c in SIDES}).withColumns({"zlevel": level(*(F.col(f"z{c}") for c in SIDES)), "znumber": F.monotonically_increasing_id()}))
    if zones.limit(LOAD + 1).count() <= LOAD:
        thin = zones.select("znumber", "zlevel", *(f"z{c}" for c in SIDES))
        # a zone touches four cells of its level at most, and four of each coarser one
        right = _cells(thin, F.sequence(F.lit(0), F.col("zlevel")), "own", "z").unionByName(_cells(thin, F.array("zlevel"), "up", "z"))
        if right.limit(LOAD + 1).count() <= LOAD:
            at = [r[0] for r in sorted(zones.select("zlevel").distinct().collect())]
            up = F.filter(F.array(*map(F.lit, at)).cast("array<int>"), lambda x: x < F.col("level"))
            left = _cells(rows, F.array("level"), "own").unionByName(_cells(rows, up, "up"))
            return _met(left.join(F.broadcast(right), CELL)).join(zones.drop("zlevel", *(f"z{c}" for c in SIDES)), "znumber").drop("znumber")
    zones, rows = zones.drop("znumber"), cut(rows)
    levels = lambda df, c: F.array(*(F.lit(r[0]) for r in sorted(df.select(c).distinct().collect()))).cast("array<int>")
    # there are DEEPEST + 1 levels at most
    of_rows, of_zones = levels(rows, "level"), levels(zones, "zlevel")
    own, up = F.array("level"), F.filter(of_zones, lambda x: x < F.col("level"))
    left = _cells(rows, own, "own").unionByName(_cells(rows, up, "up"))
    right = _cells(zones, F.filter(of_rows, lambda x: x <= F.col("zlevel")), "own", "z").unionByName(_cells(zones, F.array("zlevel"), "up", "z"))
    left, right, keys = dealt(left, right, CELL, LOAD, LOAD)
    return _met(left.join(right, keys)).drop("deal_l", "deal_r")


def _met(met: DataFrame) -> DataFrame:
    """The rows of a join by cells whose boxes meet, in one cell of those in which they do."""
    met = met.where((F.col("minx") <= F.col("zmaxx")) & (F.col("zminx") <= F.col("maxx")) & (F.col("miny") <= F.col("zmaxy")) & (F.col("zminy") <= F.col("maxy")))
    # a pair meets in several cells; it counts in that of the boxes' common lower corner
    corner = (F.col("cx") == F.floor(F.greatest("minx", "zminx") / side(F.col("at")))) & (F.col("cy") == F.floor(F.greatest("miny", "zminy") / side(F.col("at"))))
    return met.where(corner).drop(*CELL, "level", "zlevel")
