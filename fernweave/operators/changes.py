"""Differences between two snapshots of keyed records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, watched: Mapping[str, Sequence[str]]) -> DataFrame:
    """(`key`, `change`, `old`, `new`): records added and removed, and watched fields that changed.

    `watched` names each kind of change with the fields that show it; two numbers are told
    apart as `<kind>Increased` and `<kind>Decreased`.
    """
    fields = [f for group in watched.values() for f in group]
    a = old.select(key, F.lit(True).alias("_a"), F.struct(*fields).alias("a"))
    b = new.select(key, F.lit(True).alias("_b"), F.struct(*fields).alias("b"))
    both = a.join(b, key, "full_outer")
    there = F.col("_a") & F.col("_b")
    kinds = {f.name: f.dataType.typeName() for f in old.schema.fields}

    def row(change: Column, before: Column, after: Column) -> Column:
        return F.struct(change.alias("change"), before.cast("string").alias("old"), after.cast("string").alias("new"))

    none = F.lit(None).cast("string")
    found = [F.when(F.col("_a").isNull(), row(F.lit("added"), none, none)), F.when(F.col("_b").isNull(), row(F.lit("removed"), none, none))]
    for kind, group in watched.items():
        for f in group:
            x, y = F.col(f"a.{f}"), F.col(f"b.{f}")
            name = F.lit(f"{kind}Changed")
            if kinds[f] in ("integer", "long", "double", "float"):
                name = F.when(y > x, f"{kind}Increased").when(y < x, f"{kind}Decreased").otherwise(f"{kind}Changed")
            found.append(F.when(there & ~x.eqNullSafe(y), row(name, x, y)))
    return both.select(key, F.explode(F.array_compact(F.array(*found))).alias("c")).select(key, "c.*")
