"""Contracts as violation lists, and checks between tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_violations(rows: DataFrame, rules: Mapping[str, Column], name: str = "violations") -> DataFrame:
    """Rows with the codes of the rules they break; a rule that can't be decided is broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]
    return rows.withColumn(name, F.array_compact(F.array(*broken)))


def split_by_validity(rows: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with their violations)."""
    checked = with_violations(rows, rules)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def required(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The rows, failing the run at the first that breaks a rule."""
    checked = with_violations(rows, rules)
    test = F.assert_true(F.size("violations") == 0, F.concat(F.lit("CONTRACT: "), F.array_join("violations", ","))).isNull()
    return checked.where(test).drop("violations")


def duplicate_ids(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose reference isn't in the other table."""
    return rows.where(F.col(key).isNotNull()).join(other.select(key).distinct(), key, "left_anti")
