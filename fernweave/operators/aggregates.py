"""Counts and reports over analysed feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distribution(rows: DataFrame, keys: Sequence[str], value: Column, seq: str) -> DataFrame:
    """(`keys`, `value`, `n`, `first_seq`): how often each non-blank value occurs and where first."""
    named = rows.withColumn("value", value.cast("string")).where(F.col("value").isNotNull() & (F.col("value") != ""))
    return named.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first_seq"))


def ordered_list(value: Column, seq: Column, limit: int | None = None) -> Column:
    """Aggregate: the values of a group in the order of `seq`, at most `limit` of them."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(seq.alias("s"), value.alias("v")))), lambda x: x["v"])
    return F.slice(values, 1, limit) if limit else values


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    """`part / whole`, or `empty` where there is nothing."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(empty).cast("double"))


def added_maps(a: Column, b: Column) -> Column:
    """The sum of two maps of counts."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def precision_recall(pairs: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(`found`, `wanted`, `both`, `precision`, `recall`) of found pairs against true ones; nothing of nothing is 1."""
    a = pairs.select(*keys).distinct().withColumn("_found", F.lit(1))
    b = truth.select(*keys).distinct().withColumn("_true", F.lit(1))
    sums = a.join(b, list(keys), "full_outer").agg(
        F.coalesce(F.sum("_found"), F.lit(0)).alias("found"), F.coalesce(F.sum("_true"), F.lit(0)).alias("wanted"), F.count_if(F.col("_found").isNotNull() & F.col("_true").isNotNull()).alias("both")
    )
    return sums.withColumn("precision", ratio(F.col("both"), F.col("found"), 1.0)).withColumn("recall", ratio(F.col("both"), F.col("wanted"), 1.0))
