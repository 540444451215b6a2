"""Joins with the lookup rules of the pipelines: latest or first match, both sides with zeros, keyed comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_key(rows: DataFrame, keys: Sequence[str], seq: str, last: bool = False) -> DataFrame:
    """The row of each key with the smallest (or largest) `seq`; a hash aggregate with map-side combination, no sort of groups."""
    others = [c for c in rows.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    pick = (F.max_by if last else F.min_by)(packed, F.col(seq)).alias("_row")
    return rows.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*rows.columns)


def with_match(left: DataFrame, right: DataFrame, keys: Sequence[str], seq: str, last: bool = False, defaults: Mapping | None = None) -> DataFrame:
    """Left rows with the columns of their first (or last) right row by `seq`, defaults where none matches."""
    joined = left.join(one_per_key(right, keys, seq, last).drop(seq), list(keys), "left")
    return joined.fillna(dict(defaults)) if defaults else joined


def both_sides(before: DataFrame, after: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """All keys of either side with `<count>_before` and `<count>_after`, zero where a side lacks the key."""
    a = before.select(*keys, *[F.col(c).alias(f"{c}_before") for c in counts])
    b = after.select(*keys, *[F.col(c).alias(f"{c}_after") for c in counts])
    return a.join(b, list(keys), "full_outer").fillna(0, [f"{c}_{s}" for c in counts for s in ("before", "after")])


def mismatches(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(`key`, `field`, `old`, `new`) for every field that differs, nulls being equal; missing rows as field `row`."""
    a = old.select(F.col(key), F.lit(True).alias("_a"), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("a"))
    b = new.select(F.col(key), F.lit(True).alias("_b"), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("b"))
    both = a.join(b, key, "full_outer")
    lone = F.when(F.col("_a").isNull(), F.struct(F.lit("row").alias("field"), F.lit(None).cast("string").alias("old"), F.lit("present").alias("new"))).when(
        F.col("_b").isNull(), F.struct(F.lit("row").alias("field"), F.lit("present").alias("old"), F.lit(None).cast("string").alias("new"))
    )
    each = [
        F.when(F.col("_a") & F.col("_b") & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("old"), F.col(f"b.{f}").alias("new")))
        for f in fields
    ]
    return both.select(key, F.explode(F.array_compact(F.array(lone, *each))).alias("m")).select(key, "m.*")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], slice_width: int | None = None) -> DataFrame:
    """Left rows with the values of the latest right row of their key that isn't later.

    Both sides are brought into one sorted run per key and the last right values are
    carried forward. With `slice_width`, keys are split into slices of time so that a
    hot key is shared by several tasks; each slice begins with the last right row before
    it, found by one small aggregate per slice.
    """
    from pyspark.sql import Window

    names = [c for c in left.columns]
    packed = F.struct(*[F.col(v) for v in values])
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in names]).alias("_left"), F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_right"))
    empty = F.lit(None).cast(a.schema["_left"].dataType)
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), empty.alias("_left"), packed.alias("_right"))
    group = list(keys)
    if slice_width:
        part = F.floor(F.col("_t") / slice_width)
        a, b = a.withColumn("_part", part), b.withColumn("_part", part)
        group = [*keys, "_part"]
        ends = b.groupBy(*group).agg(F.max_by("_right", "_t").alias("_right"))
        parts = a.select(*group).distinct().withColumn("_need", F.lit(True)).join(ends, group, "full_outer")
        carry = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = parts.withColumn("_right", F.last("_right", ignorenulls=True).over(carry)).where(F.col("_need") & F.col("_right").isNotNull())
        starts = starts.select(*keys, F.lit(None).cast(b.schema["_t"].dataType).alias("_t"), F.lit(-1).alias("_side"), empty.alias("_left"), "_right", "_part")
        b = b.unionByName(starts)
    run = Window.partitionBy(*group).orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = a.unionByName(b).withColumn("_right", F.last("_right", ignorenulls=True).over(run)).where(F.col("_side") == 1)
    return merged.select(*[F.col(f"_left.{c}").alias(c) for c in names], *[F.col(f"_right.{v}").alias(v) for v in values])


def in_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points joined to the half-open intervals of their key that hold them, by cells of `width`."""
    cells = intervals.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return points.withColumn("_cell", F.floor(F.col(at) / width)).join(cells, [*keys, "_cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_cell")
