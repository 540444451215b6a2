"""Duplicate records by key and the merge of their fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.operators.delivery import first_copies


def first_by_key(rows: DataFrame, key: Column, seq: str) -> DataFrame:
    """The first row of each key by `seq`; rows without a key are never duplicates."""
    keyed = rows.withColumn("_key", key)
    return first_copies(keyed, ["_key"], [F.col(seq)], keep_null_keys=True).drop("_key")


def first_value(value: Column, seq: Column) -> Column:
    """Aggregate: the first non-blank value of a group in the order of `seq`."""
    usable = F.when(value.isNotNull() & (F.trim(value.cast("string")) != ""), value)
    return F.min_by(usable, F.when(usable.isNotNull(), seq))


def last_value(value: Column, seq: Column) -> Column:
    """Aggregate: the value of the last row, null or not."""
    return F.max_by(value, seq)


def members(rows: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """(`keys`, `values`): the distinct members of all lists of a key, sorted; members are made distinct before they are brought together."""
    each = rows.select(*keys, F.explode(values).alias("_m")).where(F.col("_m").isNotNull()).distinct()
    return each.groupBy(*keys).agg(F.array_sort(F.collect_set("_m")).alias(values))


def merged(rows: DataFrame, key: Column, seq: str, first: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """One row per key: first non-blank scalars, union of lists, number of records; null keys stay apart by `seq`."""
    own = F.coalesce(key, F.concat(F.lit("\x00"), F.col(seq).cast("string")))
    keyed = rows.withColumn("_key", own)
    scalars = [first_value(F.col(c), F.col(seq)).alias(c) for c in first]
    out = keyed.groupBy("_key").agg(F.min(seq).alias(seq), *scalars, F.count(F.lit(1)).alias("records"))
    for c in lists:
        out = out.join(members(keyed, ["_key"], c), "_key", "left")
    return out.drop("_key")
