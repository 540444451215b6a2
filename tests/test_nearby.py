"""Points near points and points in regions, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweave.operators import nearby

SCHEMA = "id long, y double, x double, band string, lat string"


def brute(points, radius):
    good = [(i, y, x) for i, y, x, *_ in points if y is not None and x is not None and abs(y) <= 90 and abs(x) <= 180 and (y, x) != (0, 0)]
    want = set()
    for a in good:
        for b in good:
            if a[0] < b[0] and nearby.haversine_m(a[1], a[2], b[1], b[2]) <= radius:
                want.add((a[0], b[0]))
    return want


def pairs(spark, points, radius=50.0):
    rows = spark.createDataFrame(points, SCHEMA)
    return {tuple(r) for r in nearby.near_pairs(rows, "id", F.col("y"), F.col("x"), radius).collect()}


def test_clusters_the_antimeridian_the_poles_and_bad_values(spark):
    rng = np.random.default_rng(1)
    centres = [(10.0, 20.0), (-33.0, 179.9999), (-33.0, -179.9999), (89.9995, 10.0), (89.9998, -170.0), (-89.9999, 0.0), (0.0001, 0.0001), (60.0, -180.0)]
    points = []
    for y, x in centres:
        for _ in range(25):
            points.append((len(points), float(np.clip(y + rng.normal(0, 0.0004), -90, 90)), float(np.clip(x + rng.normal(0, 0.0006), -180, 180)), "b", None))
    points += [(1000, None, 5.0, None, None), (1001, 0.0, 0.0, None, None), (1002, 0.0, 0.0, None, None), (1003, 91.0, 3.0, None, None), (1004, 10.0, 181.0, None, None), (1005, float("nan"), 1.0, None, None)]
    assert pairs(spark, points) == brute(points, 50.0)
    assert pairs(spark, points, 5000.0) == brute(points, 5000.0)


def test_hot_cells_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearby, "HOT_CELL_ROWS", 20)
    rng = np.random.default_rng(2)
    points = [(i, 48.0 + float(rng.normal(0, 0.0005)), 7.0 + float(rng.normal(0, 0.0005)), None, None) for i in range(150)]
    assert pairs(spark, points) == brute(points, 50.0)


def test_identical_points_and_empty_tables(spark):
    assert pairs(spark, [(1, 5.0, 5.0, None, None), (2, 5.0, 5.0, None, None)]) == {(1, 2)}
    assert pairs(spark, []) == set()
    with pytest.raises(ValueError):
        nearby.near_pairs(spark.createDataFrame([], SCHEMA), "id", F.col("y"), F.col("x"), 0.0)


def inside(x, y, ring):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x >= x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            hit = not hit
    return hit


def test_points_in_regions(spark):
    rng = np.random.default_rng(3)
    rings = {"triangle": [(0.0, 0.0), (1.0, 0.1), (0.3, 0.9)], "star": [(0.5, -0.5), (0.6, 0.5), (1.5, 0.4), (0.7, 0.6), (0.9, 1.4), (0.4, 0.7), (-0.5, 0.5), (0.35, 0.3)]}
    points = [(i, float(y), float(x), None, None) for i, (y, x) in enumerate(rng.uniform(-0.6, 1.6, (400, 2)))] + [(900, None, 1.0, None, None)]
    regions = spark.createDataFrame([(k, [{"lon": x, "lat": y} for x, y in r]) for k, r in rings.items()], "region string, ring array<struct<lon double, lat double>>")
    rows = spark.createDataFrame(points, SCHEMA)
    for per_task in (100_000, 3):
        got = {tuple(r) for r in nearby.points_in_regions(rows, "id", F.col("y"), F.col("x"), regions, 0.05, per_task).collect()}
        assert got == {(i, k) for i, y, x, *_ in points if y is not None for k, r in rings.items() if inside(x, y, r)}
    assert nearby.points_in_regions(rows.limit(0), "id", F.col("y"), F.col("x"), regions).count() == 0
