"""Two periods around a boundary, counted in one pass and compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SAMPLE = 8


def period_of(at: Column, boundary: Column | int, span: int) -> Column:
    """before for `[boundary - span, boundary)`, after for `[boundary, boundary + span]`, else null."""
    edge = boundary if isinstance(boundary, Column) else F.lit(boundary)
    return F.when((at >= edge - span) & (at < edge), "before").when((at >= edge) & (at <= edge + span), "after")


def compared(rows: DataFrame, keys: Sequence[str], period: Column = None) -> DataFrame:
    """(`keys`, `before`, `after`, `change`, `direction`): counts of both periods by one aggregate."""
    p = F.col("period") if period is None else period
    counted = rows.groupBy(*keys).agg(F.count_if(p == "before").alias("before"), F.count_if(p == "after").alias("after"))
    change = F.col("after") - F.col("before")
    return counted.where("before + after > 0").select(
        *keys, "before", "after", change.alias("change"), F.when(change > 0, "increased").when(change < 0, "decreased").otherwise("unchanged").alias("direction")
    )


def sentiment_shift(rows: DataFrame, keys: Sequence[str], positive: Column) -> DataFrame:
    """Positive rates of both periods and the direction of their difference; few reviews give no direction."""
    p = F.col("period")
    counted = rows.groupBy(*keys).agg(
        F.count_if(p == "before").alias("n_before"),
        F.count_if(p == "after").alias("n_after"),
        F.count_if((p == "before") & positive).alias("positive_before"),
        F.count_if((p == "after") & positive).alias("positive_after"),
    ).where("n_before + n_after > 0")
    delta = F.round(F.col("positive_after") / F.col("n_after") - F.col("positive_before") / F.col("n_before"), 12)
    few = (F.col("n_before") < LEAST_SAMPLE) | (F.col("n_after") < LEAST_SAMPLE)
    direction = (
        F.when(few, "insufficient_data")
        .when(delta <= -0.10, "much_worse")
        .when(delta <= -0.04, "worse")
        .when(delta < 0.04, "stable")
        .when(delta < 0.10, "better")
        .otherwise("much_better")
    )
    return counted.withColumn("direction", direction)


def coverage(rows: DataFrame, keys: Sequence[str], at: str, boundary: int, span: int) -> DataFrame:
    """First and last time seen in each period and whether it is covered: full, partial or insufficient."""
    seen = rows.where(F.col("period").isNotNull()).groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    start = F.when(F.col("period") == "before", boundary - span).otherwise(boundary)
    near = F.col("first_at") <= start + 86400
    return seen.withColumn("status", F.when(F.col("n") < LEAST_SAMPLE, "insufficient").when(near, "full").otherwise("partial"))


def detected(counts: DataFrame) -> DataFrame:
    """Signs of change in topic counts: new issue, regression and improvement.

    `counts` has `before`, `after`, `negative_before`, `negative_after`, `n_before` and
    `n_after` (all reviews of the period).
    """
    rate_before = F.when(F.col("n_before") > 0, F.col("before") / F.col("n_before")).otherwise(0.0)
    rate_after = F.when(F.col("n_after") > 0, F.col("after") / F.col("n_after")).otherwise(0.0)
    share = F.when(F.col("after") > 0, F.col("negative_after") / F.col("after")).otherwise(0.0)
    share_before = F.when(F.col("before") > 0, F.col("negative_before") / F.col("before")).otherwise(0.0)
    enough = (F.col("after") >= 3) & (share >= 0.6)
    return counts.select(
        "*",
        ((rate_before <= 0.05) & (rate_after >= 0.12) & enough).alias("new_issue"),
        ((F.round(rate_after - rate_before, 12) >= 0.08) & enough).alias("regression"),
        ((F.col("negative_before") >= 3) & (F.round(share_before - share, 12) >= 0.08)).alias("improvement"),
    )


def confidence(before: Column, after: Column, status_before: Column, status_after: Column, delta: Column, consistency: float = 0.8) -> Column:
    """Confidence in a comparison: sample size and coverage with .35 each, consistency of themes with .2, size of the shift with .1.

    `status_*` is full, partial or insufficient. A partly covered period caps it at .69, a
    thin one (under `LEAST_SAMPLE` reviews or insufficiently covered) at .39.
    """
    quality = [F.when(s == "full", 1.0).when(s == "partial", 0.65).when(s == "insufficient", 0.25).otherwise(0.5) for s in (status_before, status_after)]
    sample = F.least(F.lit(1.0), F.least(before, after) / 40)
    shift = F.when(delta.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.abs(delta) / 0.1))
    raw = sample * 0.35 + F.least(*quality) * 0.35 + consistency * 0.2 + shift * 0.1
    thin = (before < LEAST_SAMPLE) | (after < LEAST_SAMPLE) | (status_before == "insufficient") | (status_after == "insufficient")
    partial = (status_before != "full") | (status_after != "full")
    return F.greatest(F.lit(0.0), F.least(raw, F.when(thin, 0.39).when(partial, 0.69).otherwise(1.0)))


def confidence_label(value: Column) -> Column:
    """high from .8, medium from .6, else low."""
    return F.when(value >= 0.8, "high").when(value >= 0.6, "medium").otherwise("low")
