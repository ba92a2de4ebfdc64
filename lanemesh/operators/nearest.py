"""Nearest sites over k-d cells, with a packed tree of boxes in each.

Splits are fitted to a bounded sample of the sites, so cells hold about as many sites wherever these lie, in
a city or on an ocean. A point first looks in its own cell; that distance bounds how far the nearest can be,
and only cells whose box lies within it are looked in after. A task holds the sites of one cell, SITES at
most, and POINTS of the points that look there; cells with more of either are dealt out.

Sites are compared as they lie in the plane of raw degrees, or as points of the unit sphere, where the
shortest chord is the shortest way: neither poles nor the date line are special.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanemesh.functions import geo
from lanemesh.lineage import cut
from lanemesh.operators.boxes import dealt

#: Sites that the splits are fitted to; cells at most, whose boxes every task knows; sites a cell is made for.
SAMPLE, CELLS, IN_CELL = 65_536, 1024, 16_384
#: Points and sites of a cell that meet in one task; points compared at a time; boxes in a box.
POINTS, SITES, AT_ONCE, FAN = 16_384, 262_144, 1024, 32
#: What rounding may make of squared distances.
RELATIVE, ABSOLUTE = 1e-9, 1e-27


def _loose(d2: np.ndarray) -> np.ndarray:
    return d2 * (1 + RELATIVE) + ABSOLUTE + 1e-14 * np.sqrt(d2)


def places(lat: np.ndarray, lon: np.ndarray, metric: str) -> np.ndarray:
    """Rows of coordinates: degrees, or x, y, z on the unit sphere."""
    if metric == "planar":
        return np.column_stack((lat, lon))
    lat, lon = np.radians(lat), np.radians(lon)
    return np.column_stack((np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)))


def gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of places from boxes, over the last axis."""
    return (np.maximum(0.0, np.maximum(low - x, x - high)) ** 2).sum(axis=-1)


class Splits:
    """A k-d tree of `depth` levels over a sample: at each node the widest side is cut at its median."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, inner = depth, 2**depth - 1
        self.side, self.at = np.zeros(inner, np.int64), np.full(inner, np.inf)
        held = {0: sample}
        for node in range(inner):
            x = held.pop(node)
            if len(x) > 1 and (x != x[0]).any():
                side = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
                values = np.unique(x[:, side])
                at = max(float(np.median(x[:, side])), float(values[1]))
                self.side[node], self.at[node] = side, at
            low = x[:, self.side[node]] < self.at[node] if len(x) else np.zeros(0, bool)
            if 2 * node + 1 < inner:
                held[2 * node + 1], held[2 * node + 2] = x[low], x[~low]

    def cells(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.side[node]] >= self.at[node])
        return node - (2**self.depth - 1)


def _packed(x: np.ndarray) -> np.ndarray:
    """An order in which each run of FAN, FAN squared, ... sites lies close together."""
    out, work = [], [np.arange(len(x))]
    while work:
        own = work.pop()
        if len(own) <= FAN:
            out.append(own)
            continue
        unit = FAN ** int(math.log(len(own) - 1, FAN) + 1e-9)
        cut_at = max(1, -(-len(own) // unit) // 2) * unit
        side = int(np.argmax(x[own].max(axis=0) - x[own].min(axis=0)))
        own = own[np.argpartition(x[own, side], cut_at - 1)]
        work += [own[cut_at:], own[:cut_at]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Boxes:
    """A packed tree: level 0 are the sites in packed order, a box of the next level holds FAN of the one below."""

    def __init__(self, x: np.ndarray):
        self.order = _packed(x)
        self.low, self.high = [x[self.order]], [x[self.order]]
        while len(self.low[-1]) > FAN:
            at = np.arange(0, len(self.low[-1]), FAN)
            low, high = np.minimum.reduceat(self.low[-1], at), np.maximum.reduceat(self.high[-1], at)
            self.low.append(low)
            self.high.append(high)

    def _inside(self, boxes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of `boxes` (of the level above) each member comes from, and the member."""
        first = boxes * FAN
        n = np.minimum(first + FAN, len(self.low[level])) - first
        which = np.repeat(np.arange(len(boxes)), n)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]

    def near(self, x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Point, site and squared distance of what may be nearest to each point and within `limit` (squared): all that rounding can't tell from the least."""
        top = len(self.low) - 1
        point = np.repeat(np.arange(len(x)), len(self.low[top]))
        member = np.tile(np.arange(len(self.low[top])), len(x))
        # straight down to a site by the nearest box of each level: that bounds the least distance
        at, below = point, member
        for level in range(top, -1, -1):
            gap = gaps(x[at], self.low[level][below], self.high[level][below])
            first = np.lexsort((gap, at))
            first = first[np.diff(at[first], prepend=-1) != 0]
            if not level:
                limit = np.minimum(limit, gap[first])
                break
            which, inner = self._inside(below[first], level - 1)
            at, below = at[first][which], inner
        # then all boxes within that distance
        for level in range(top, -1, -1):
            gap = gaps(x[point], self.low[level][member], self.high[level][member])
            if not level:
                np.minimum.at(limit, point, gap)
            own = gap <= _loose(limit)[point]
            point, member, gap = point[own], member[own], gap[own]
            if level:
                which, member = self._inside(member, level - 1)
                point = point[which]
        return point, self.order[member], gap


def _look(points: pa.Table, sites: pa.Table, key: str, metric: str) -> pa.Table:
    get = lambda table, name: table[name].to_numpy()
    if not len(points) or not len(sites):
        who, what, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    else:
        x, limit = places(get(points, "lat"), get(points, "lon"), metric), get(points, "limit")
        tree = Boxes(places(get(sites, "nlat"), get(sites, "nlon"), metric))
        found = [(k, tree.near(x[k : k + AT_ONCE], limit[k : k + AT_ONCE])) for k in range(0, len(x), AT_ONCE)]
        who, what, far = np.concatenate([k + f[0] for k, f in found]), np.concatenate([f[1] for _, f in found]), np.concatenate([f[2] for _, f in found])
    own, met = points.take(pa.array(who)), sites.take(pa.array(what))
    return pa.table({key: own[key], **{c: own[c] for c in ("lat", "lon", "home")}, **{c: met[c] for c in ("id", "nlat", "nlon")}, "far": pa.array(far)})


def candidates(points: DataFrame, sites: DataFrame, key: str, metric: str, within: float | None = None) -> DataFrame:
    """key, lat, lon, id, nlat, nlon: for each point (key, lat, lon) the sites (id, lat, lon) that rounding can't tell from the nearest, `within` (degrees, or radians along the sphere) if given. Of sites at one place the least id stands for all. Rows without coordinates take no part."""
    spark = points.sparkSession
    whole = lambda df: df.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    points = whole(points.select(key, "lat", "lon"))
    sites = cut(whole(sites.select("id", "lat", "lon")).groupBy("lat", "lon").agg(F.min("id").alias("id")))
    kinds = {f.name: f.dataType.simpleString() for f in [*points.schema, *sites.schema]}
    schema = f"{key} {kinds[key]}, lat double, lon double, home int, id {kinds['id']}, nlat double, nlon double, far double"
    n = sites.count()
    if not n:
        return spark.createDataFrame([], schema).drop("home", "far")
    sample = sites.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("lat", "lon").toArrow()
    depth = min(int(math.log2(CELLS)), max(0, math.ceil(math.log2(n / IN_CELL))))
    splits = Splits(places(sample["lat"].to_numpy(), sample["lon"].to_numpy(), metric), depth)
    sides = range(2 if metric == "planar" else 3)

    def celled(batches):
        for b in batches:
            x = places(b.column(1).to_numpy(), b.column(2).to_numpy(), metric)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(splits.cells(x).astype(np.int32)), *(pa.array(x[:, s]) for s in sides)], [*b.schema.names, "cell", *(f"x{s}" for s in sides)])

    placed = sites.select("id", F.col("lat").alias("nlat"), F.col("lon").alias("nlon")).mapInArrow(celled, f"id {kinds['id']}, nlat double, nlon double, cell int, " + ", ".join(f"x{s} double" for s in sides))
    placed = cut(placed)
    # CELLS rows at most
    ends = placed.groupBy("cell").agg(*(f(f"x{s}").alias(f"{n}{s}") for n, f in (("low", F.min), ("high", F.max)) for s in sides)).orderBy("cell").toArrow()
    known = ends["cell"].to_numpy()
    low, high = (np.column_stack([ends[f"{n}{s}"].to_numpy() for s in sides]) for n in ("low", "high"))
    placed = placed.select("cell", "id", "nlat", "nlon")
    bound = np.inf if within is None else within**2 if metric == "planar" else (2 * math.sin(min(within, math.pi) / 2)) ** 2
    bound = float(_loose(np.array(bound))) if math.isfinite(bound) else bound

    def homes(batches):
        """Points to their own cell, or the nearest that has sites; those with none near enough go."""
        for b in batches:
            x = places(b.column(1).to_numpy(), b.column(2).to_numpy(), metric)
            cell = splits.cells(x)
            lost = np.flatnonzero(~np.isin(cell, known))
            for k in range(0, len(lost), AT_ONCE):
                at = lost[k : k + AT_ONCE]
                cell[at] = known[gaps(x[at, None], low, high).argmin(axis=1)]
            cell = pa.array(cell.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, cell, cell, pa.array(np.full(len(x), bound))], [*b.schema.names, "cell", "home", "limit"])

    def others(batches):
        """Points to the other cells within their limit."""
        for b in batches:
            lat, lon, home, limit = (b.column(c).to_numpy() for c in range(1, 5))
            for k in range(0, b.num_rows, AT_ONCE):
                part = slice(k, k + AT_ONCE)
                near = gaps(places(lat[part], lon[part], metric)[:, None], low, high) <= _loose(limit[part])[:, None]
                i, j = np.nonzero(near & (known[None] != home[part, None]))
                rows = b.take(pa.array(k + i))
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(known[j].astype(np.int32)), *rows.columns[3:]], [key, "lat", "lon", "cell", "home", "limit"])

    asked = f"{key} {kinds[key]}, lat double, lon double, cell int, home int, limit double"

    def look(rows: DataFrame) -> DataFrame:
        left, right, keys = dealt(rows, placed, ["cell"], POINTS, SITES)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda p, s: _look(p, s, key, metric), schema)

    begun = cut(points.mapInArrow(homes, asked))
    first = cut(look(begun))
    best = first.groupBy(key, "lat", "lon").agg(F.min("far").alias("limit"))
    again = begun.select(key, "lat", "lon", "home").join(best, [key, "lat", "lon"], "left").select(key, "lat", "lon", "home", F.coalesce("limit", F.lit(bound)).alias("limit"))
    second = look(cut(again.mapInArrow(others, asked))) if depth else first.limit(0)
    return first.union(second).drop("home", "far")


def nearest_nodes(points: DataFrame, nodes: DataFrame, key: str = "point_id", metric: str = "planar", within: float | None = None) -> DataFrame:
    """points with node_id and distance (degrees if planar, else metres) of the nearest node; ties to the least id. `within`, in the same unit, leaves out what is farther."""
    reach = within if within is None or metric == "planar" else within / geo.EARTH_RADIUS
    met = candidates(points, nodes, key, metric, reach)
    if metric == "planar":
        distance = F.sqrt(geo.planar2(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon")))
    else:
        distance = geo.haversine(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"))
    best = met.groupBy(key).agg(F.min(F.struct(distance.alias("distance"), F.col("id").alias("node_id"))).alias("b")).select(key, "b.node_id", "b.distance")
    return best if within is None else best.where(F.col("distance") <= within)
