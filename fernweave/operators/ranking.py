"""Top rows, caps, deterministic samples and fair interleaving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.functions.numbers import polynomial_hash


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Rows with their place inside their key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first `n` rows of each key; the planner cuts each task's share to `n` before the shuffle."""
    return ranked(rows, keys, order, "rank").where(F.col("rank") <= n)


def seeded_sample(rows: DataFrame, keys: Sequence[str], record_id: Column, n: int, seed: str) -> DataFrame:
    """`n` rows of each key, the ones with the smallest seeded hash of their id, among equals the smallest id; fewer rows stay all."""
    hashed = rows.withColumn("_h", polynomial_hash(F.concat(F.lit(f"{seed}|"), record_id)))
    return top_per_key(hashed, keys, [F.col("_h"), record_id.cast("string")], n).drop("_h", "rank")


def interleaved(rows: DataFrame, queue: Sequence[str], order: Sequence[Column], queue_order: Sequence[Column], n: int) -> DataFrame:
    """The first `n` rows when queues are served in turn: all first rows, then all second rows."""
    return ranked(rows, queue, order, "turn").where(F.col("turn") <= n).orderBy("turn", *queue_order).limit(n)
