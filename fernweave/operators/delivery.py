"""Messages delivered at least once: keep exactly one copy of each identifier.

Every function takes the key columns and an ordering; the ordering must end in a
column that is unique among the copies of one key, else equal rows are taken as
interchangeable. Rows whose key is null have no identity: `first_copies` keeps
them all, `repeated_copies` never reports them. Empty tables give empty results,
and extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def _fresh(rows: DataFrame, stem: str) -> str:
    name, taken = stem, {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


def _with_key(rows: DataFrame, keys: Sequence[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).isNotNull()
    return test


def first_copies(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], keep_null_keys: bool = True) -> DataFrame:
    """One row per key: the first by `order`.

    The filter on a row number lets the planner cut every map task's share to one row
    per key before the shuffle, so a key with a third of all rows sends one row per task.
    """
    rank = _fresh(rows, "_copy")
    known = _with_key(rows, keys)
    kept = _ranked(rows.where(known), keys, order, rank).where(F.col(rank) == 1).drop(rank)
    return kept.unionByName(rows.where(~known)) if keep_null_keys else kept


def repeated_copies(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], row_id: str) -> DataFrame:
    """`row_id` of every row that `first_copies` leaves out (one row per left-out row).

    Winners are found with the map-side cut, then taken from all rows by the unique
    `row_id`; no join on the possibly hot key is made. A repeated `row_id` comes out
    once less than it occurs when one of its rows is the winner.
    """
    known = rows.where(_with_key(rows, keys))
    winners = first_copies(known, keys, order, keep_null_keys=False)
    return known.select(row_id).exceptAll(winners.select(row_id))


def new_messages(stored: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First copy of each message of `batch` whose key isn't stored yet; null keys are dropped.

    Both sides are cut to one row per key before they meet, so neither side of the
    anti-join can be skewed.
    """
    seen = stored.where(_with_key(stored, keys)).select(*keys).distinct()
    return first_copies(batch, keys, order, keep_null_keys=False).join(seen, list(keys), "left_anti")
