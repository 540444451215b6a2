"""Points near points, and points in regions, by slabs of a trapezoidal decomposition.

A region's boundary is cut by horizontal slabs of latitude. Inside a slab its edges
are ordered by longitude, so a point is located by binary search among the edges of
its own slab. Slabs are grouped in bands and cut by walls of longitude into cells;
a cell is the unit that is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
SLABS_PER_BAND = 8
POLAR_LATITUDE = 89.0
HOT_CELL_ROWS = 20_000
CANDIDATES_PER_STEP = 2_000_000


def usable_coordinates(latitude: Column, longitude: Column) -> Column:
    """True where both are present, in range and not the placeholder 0/0."""
    inside = latitude.between(-90.0, 90.0) & longitude.between(-180.0, 180.0)
    return F.coalesce(inside & ~F.isnan(latitude) & ~F.isnan(longitude) & ~((latitude == 0.0) & (longitude == 0.0)), F.lit(False))


def haversine_m(lat1, lon1, lat2, lon2):
    """Great-circle metres between numpy arrays of degrees."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(a, 0.0, 1.0)))


def _whole_cells(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 40_000) -> Iterator[pd.DataFrame]:
    """Runs of whole cells out of a partition sorted by `keys`, of about `rows` rows or one larger cell."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        joined = pd.concat(held, ignore_index=True)
        last = joined[keys].to_numpy()
        changed = np.flatnonzero((last[1:] != last[:-1]).any(axis=1))
        if len(changed):
            cut = changed[-1] + 1
            yield joined.iloc[:cut]
            joined = joined.iloc[cut:]
        held = [joined]
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def _slab_search(cells: pd.DataFrame, slab: float, radius_m: float, keys: list[str]) -> Iterator[pd.DataFrame]:
    """Pairs of one run of cells: region edges in slabs, points located by binary search."""
    cell = np.unique(cells[keys].to_numpy(), axis=0, return_inverse=True)[1].ravel().astype(np.int64)
    lat, lon, ids = cells["lat"].to_numpy(), cells["lon"].to_numpy(), cells["id"].to_numpy()
    half, band = cells["half"].to_numpy(), cells["band"].to_numpy()
    reg, pts = np.flatnonzero(cells["as_region"].to_numpy()), np.flatnonzero(cells["as_point"].to_numpy())
    if not len(reg) or not len(pts):
        return
    reach = math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9)
    low = np.floor((lat[reg] - reach + 90) / slab).astype(np.int64)
    high = np.floor((lat[reg] + reach + 90) / slab).astype(np.int64)
    low = np.maximum(low, band[reg] * SLABS_PER_BAND)
    high = np.minimum(high, band[reg] * SLABS_PER_BAND + SLABS_PER_BAND - 1)
    many = np.maximum(high - low + 1, 0)
    src = np.repeat(reg, many)
    at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    point_slab = np.floor((lat[pts] + 90) / slab).astype(np.int64)
    span = np.int64(1 << 32)
    slabs, codes = np.unique(np.concatenate([cell[src] * span + at, cell[pts] * span + point_slab]), return_inverse=True)
    codes = codes.ravel()
    edge_slab, point_slab = codes[: len(src)], codes[len(src) :]
    width = np.zeros(len(slabs))
    np.maximum.at(width, edge_slab, half[src])
    left = edge_slab * 2000.0 + (lon[src] - half[src] + 600.0)
    order = np.argsort(left, kind="stable")
    left, src = left[order], src[order]
    at_point = point_slab * 2000.0 + (lon[pts] + 600.0)
    pad = 1e-6
    first = np.searchsorted(left, at_point - 2 * width[point_slab] - pad, "left")
    last = np.searchsorted(left, at_point + pad, "right")
    count = np.maximum(last - first, 0)
    ends = np.cumsum(count)
    start = 0
    while start < len(pts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CANDIDATES_PER_STEP, "right")))
        n = count[start:stop]
        p = np.repeat(pts[start:stop], n)
        r = src[np.repeat(first[start:stop], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        ahead = ids[r] < ids[p]
        p, r = p[ahead], r[ahead]
        near = haversine_m(lat[r], lon[r], lat[p], lon[p]) <= radius_m
        yield pd.DataFrame({"id_a": ids[r[near]], "id_b": ids[p[near]]})
        start = stop


def near_pairs(points: DataFrame, id_col: str, latitude: Column, longitude: Column, radius_m: float) -> DataFrame:
    """All pairs (`id_a` < `id_b`) at most `radius_m` metres apart along the great circle.

    The region of a point is the box around its circle; it is sent to the cells it
    meets (mostly one), each point only to its own cell. Rows without usable
    coordinates take no part, a repeated id pairs with other ids once per row, and the
    antimeridian and the poles need no special input. A cell of more than
    `HOT_CELL_ROWS` points is processed in blocks of points against blocks of regions.
    """
    reach = math.degrees(radius_m / EARTH_RADIUS_M)
    if not 0 < reach < 1:
        raise ValueError("radius_m must be above 0 and under about 110 km")
    slab = reach
    band_h, block_w = slab * SLABS_PER_BAND, max(0.008, slab * SLABS_PER_BAND * 2)
    base = (
        points.select(F.col(id_col).cast("long").alias("id"), latitude.cast("double").alias("lat"), longitude.cast("double").alias("lon"))
        .where(F.col("id").isNotNull() & usable_coordinates(F.col("lat"), F.col("lon")))
    )

    def band_of(lat: Column) -> Column:
        return F.floor((F.floor((lat + 90.0) / slab)) / SLABS_PER_BAND).cast("long")

    def polar(band: Column) -> Column:
        return (F.abs((band + 0.5) * band_h - 90.0) + band_h) >= POLAR_LATITUDE

    def block_of(band: Column, lon: Column) -> Column:
        return F.when(polar(band), F.lit(0)).otherwise(F.floor((lon + 180.0) / block_w)).cast("long")

    sine = math.sin(math.radians(reach))
    wide = F.col("lat").between(-90 + reach * 2, 90 - reach * 2)
    half = F.when(wide, F.degrees(F.asin(F.least(F.lit(1.0), F.lit(sine) / F.cos(F.radians(F.col("lat"))))))).otherwise(F.lit(360.0)) * (1 + 1e-9)
    placed = base.withColumn("band", band_of(F.col("lat"))).withColumn("half", half)
    points_side = placed.withColumn("block", block_of(F.col("band"), F.col("lon"))).withColumn("as_point", F.lit(True))
    edge = reach * (1 + 1e-6)
    regions = (
        placed.withColumn(
            "lon",
            F.explode(
                F.filter(
                    F.array(F.col("lon"), F.when(F.col("lon") - F.col("half") < -180, F.col("lon") + 360.0), F.when(F.col("lon") + F.col("half") > 180, F.col("lon") - 360.0)),
                    lambda x: x.isNotNull(),
                )
            ),
        )
        .withColumn("band", F.explode(F.sequence(band_of(F.col("lat") - edge), band_of(F.col("lat") + edge))))
        .withColumn("west", block_of(F.col("band"), F.greatest(F.lit(-180.0), F.col("lon") - F.col("half") - 1e-9)))
        .withColumn("east", block_of(F.col("band"), F.least(F.lit(180.0), F.col("lon") + F.col("half") + 1e-9)))
        .where(F.col("west") <= F.col("east"))
        .withColumn("block", F.explode(F.sequence("west", "east")))
    )
    hot = points_side.groupBy("band", "block").count().where(F.col("count") > HOT_CELL_ROWS)
    hot = hot.select("band", "block", F.ceil(F.col("count") / HOT_CELL_ROWS).cast("int").alias("parts"))
    cols = ["id", "lat", "lon", "half", "band", "block", "as_region", "as_point", "pi", "pj"]
    part = F.coalesce(F.col("parts"), F.lit(1))
    own = F.pmod(F.xxhash64("id"), part).cast("int")
    others = F.explode(F.sequence(F.lit(0), part - 1))
    as_points = (
        points_side.withColumn("as_region", F.lit(False)).join(hot, ["band", "block"], "left").withColumn("pi", own).withColumn("pj", others).select(*cols)
    )
    as_regions = (
        regions.withColumn("as_region", F.lit(True)).withColumn("as_point", F.lit(False)).join(hot, ["band", "block"], "left").withColumn("pj", own).withColumn("pi", others).select(*cols)
    )
    keys = ["band", "block", "pi", "pj"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cells in _whole_cells(batches, keys):
            yield from _slab_search(cells, slab, radius_m, keys)

    together = as_points.unionByName(as_regions).repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInPandas(search, "id_a long, id_b long")


def _edges_left(lat: np.ndarray, lon: np.ndarray, y1: np.ndarray, x1: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """How many of the ordered edges of one trapezoid row lie left of each point, by binary search."""
    low, high = np.zeros(len(lat), np.int64), np.full(len(lat), len(y1), np.int64)
    while (low < high).any():
        middle = (low + high) // 2
        k = np.minimum(middle, len(y1) - 1)
        left = x1[k] + (lat - y1[k]) * slope[k] <= lon
        searching = low < high
        low, high = np.where(searching & left, middle + 1, low), np.where(searching & ~left, middle, high)
    return low


def _locate(points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Regions of the points of one slab.

    The slab is cut at every corner, so that edges cross a row from bottom to top. Where
    they don't cross one another they have one order, and the regions between two edges
    are known; rows in which regions overlap are searched region by region.
    """
    out: list[tuple[np.ndarray, str]] = []
    ids, lat, lon = (points[c].to_numpy() for c in ("id", "lat", "lon"))
    y1, x1, y2, x2, region = (edges[c].to_numpy() for c in ("y1", "x1", "y2", "x2", "region"))
    cuts = np.unique(np.concatenate([y1, y2]))
    slot = np.searchsorted(cuts, lat, "right") - 1
    for s in np.unique(slot):
        if s < 0 or s + 1 >= len(cuts):
            continue
        mine = np.flatnonzero(slot == s)
        e = np.flatnonzero((y1 <= cuts[s]) & (y2 >= cuts[s + 1]))
        slope = (x2[e] - x1[e]) / (y2[e] - y1[e])
        bottom, top = (x1[e] + (y - y1[e]) * slope for y in (cuts[s], cuts[s + 1]))
        order = np.lexsort((top, bottom))
        e, slope, top = e[order], slope[order], top[order]
        if (np.diff(top) >= 0).all():
            place = _edges_left(lat[mine], lon[mine], y1[e], x1[e], slope)
            sorted_place = np.argsort(place, kind="stable")
            ends = np.searchsorted(place[sorted_place], np.arange(len(e) + 1), "right")
            inside: set = set()
            for k in range(len(e) + 1):
                here = mine[sorted_place[ends[k - 1] if k else 0 : ends[k]]]
                out += [(ids[here], r) for r in inside if len(here)]
                if k < len(e):
                    inside ^= {region[e[k]]}
        else:
            for r in np.unique(region[e]):
                own = np.flatnonzero(region[e] == r)
                place = _edges_left(lat[mine], lon[mine], y1[e[own]], x1[e[own]], slope[own])
                out.append((ids[mine[place % 2 == 1]], r))
    if not out:
        return pd.DataFrame({"id": np.array([], np.int64), "region": np.array([], object)})
    return pd.DataFrame({"id": np.concatenate([i for i, _ in out]), "region": np.concatenate([np.full(len(i), r, object) for i, r in out])})


def points_in_regions(points: DataFrame, id_col: str, latitude: Column, longitude: Column, regions: DataFrame, slab_degrees: float = 0.05, points_per_task: int = 100_000) -> DataFrame:
    """(`id`, `region`) for every point inside a region; borders belong to the region above and to the right.

    `regions` has `region` (string) and `ring`, an array of (lon, lat) structs in
    order, closed or open, of a region that doesn't cross the antimeridian. Boundary
    edges are cut into slabs of `slab_degrees`; a slab with more than
    `points_per_task` points is searched in parts, its edges copied to each.
    """
    pts = points.select(F.col(id_col).cast("long").alias("id"), latitude.cast("double").alias("lat"), longitude.cast("double").alias("lon"))
    pts = pts.where(F.col("id").isNotNull() & usable_coordinates(F.col("lat"), F.col("lon")))

    def slab_of(lat: Column) -> Column:
        return F.floor((lat + 90.0) / slab_degrees).cast("long")

    pts = pts.withColumn("slab", slab_of(F.col("lat")))
    corner = F.posexplode("ring").alias("k", "c")
    first = F.element_at("ring", 1)
    edges = (
        regions.where(F.size("ring") >= 3)
        .withColumn("ring", F.concat("ring", F.array(first)))
        .select("region", F.col("ring").alias("r"), corner)
        .where(F.col("k") < F.size("r") - 1)
        .select("region", F.col("c").alias("a"), F.element_at("r", F.col("k") + 2).alias("b"))
        .where(F.col("a.lat") != F.col("b.lat"))
        .select("region", F.when(F.col("a.lat") < F.col("b.lat"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).alias("e"))
        .select("region", F.col("e.a.lat").alias("y1"), F.col("e.a.lon").alias("x1"), F.col("e.b.lat").alias("y2"), F.col("e.b.lon").alias("x2"))
        .withColumn("slab", F.explode(F.sequence(slab_of(F.col("y1")), slab_of(F.col("y2")))))
    )
    parts = pts.groupBy("slab").count().select("slab", F.ceil(F.col("count") / points_per_task).cast("int").alias("parts"))
    left = pts.join(parts, "slab").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    right = edges.join(parts, "slab").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return (
        left.groupBy("slab", "part")
        .cogroup(right.groupBy("slab", "part"))
        .applyInPandas(_locate, "id long, region string")
    )
