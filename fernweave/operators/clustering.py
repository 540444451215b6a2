"""Clusters of similar titles and one-to-one matches, without collecting groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernweave.session import cut_lineage


def tokens(title: Column) -> Column:
    """Distinct lower-case words of more than two letters or digits."""
    return F.array_distinct(F.filter(F.split(F.lower(title), "[^a-z0-9]+"), lambda t: F.length(t) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Shared members over all members; nothing over nothing is 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


# Weights of a platform score, its acceptance, and what counts as dominance or evidence.
SHARED_SCORE = 0.75
DOMINANCE = 2
LEAST_MENTIONS = 2


def platform_score(pairs: DataFrame) -> DataFrame:
    """`pairs` with `hundredths`: half for shared topics, two fifths for shared title words, a tenth for like severities."""
    severity = F.when(F.col("severity_a") == F.col("severity_b"), 1.0).when((F.col("severity_a") == "unknown") | (F.col("severity_b") == "unknown"), 0.7).otherwise(0.4)
    score = jaccard(F.col("topics_a"), F.col("topics_b")) * 0.5 + jaccard(F.col("tokens_a"), F.col("tokens_b")) * 0.4 + severity * 0.1
    return pairs.withColumn("hundredths", F.round(100 * score + 1e-9).cast("long"))


def dominance(a: str, b: str) -> Column:
    """Which side of a match has twice the mentions of the other, or `shared`."""
    return F.when(F.col(a) >= DOMINANCE * F.col(b), "dominant_a").when(F.col(b) >= DOMINANCE * F.col(a), "dominant_b").otherwise("shared")


def similar_titles(titles: DataFrame, block: Sequence[str], least: float = 0.5) -> DataFrame:
    """(`a`, `b`): pairs of `id` of one block whose token sets reach `least`.

    Only a set's rarest tokens can decide: with the tokens of each title ordered from rare
    to frequent, two sets of similarity `least` share one of their first
    `n - ceil(least * n) + 1` tokens, so only those are joined on.
    """
    words = titles.select(*block, "id", F.explode("tokens").alias("t"))
    often = words.groupBy(*block, "t").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy(*block, "id").orderBy("df", "t")
    size = F.size("tokens")
    placed = words.join(often, [*block, "t"]).withColumn("k", F.row_number().over(order)).join(titles.select(*block, "id", "tokens"), [*block, "id"])
    prefix = placed.where(F.col("k") <= size - F.ceil(size * least) + 1)
    a = prefix.select(*block, "t", F.col("id").alias("a"), F.col("tokens").alias("ta"))
    b = prefix.select(*block, "t", F.col("id").alias("b"), F.col("tokens").alias("tb"))
    near = (F.size("ta") >= F.size("tb") * least) & (F.size("tb") >= F.size("ta") * least)
    met = a.join(b, [*block, "t"]).where((F.col("a") < F.col("b")) & near)
    return met.where(jaccard(F.col("ta"), F.col("tb")) >= least).select("a", "b").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(`id`, `root`): the smallest id reachable from each node.

    Large stars and small stars alternate until no edge changes; each round is written
    to the checkpoint folder. Only the number of edges and two sums of their hashes reach
    the driver.
    """

    def mark(edges: DataFrame) -> tuple:
        h = F.xxhash64("v", "u")
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())

    pairs = cut_lineage(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct())
    now = mark(pairs)
    while True:
        both = pairs.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(pairs.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").unionByName(low.select("v", F.col("m").alias("u"))).distinct()
        after = cut_lineage(small)
        before, now = now, mark(after)
        pairs = after
        if before == now:
            break
    return nodes.select("id").distinct().join(pairs.withColumnRenamed("v", "id"), "id", "left").select("id", F.coalesce("u", "id").alias("root"))


def greedy_pairs(scored: DataFrame, least: float) -> DataFrame:
    """(`a`, `b`, `score`): the one-to-one matches that taking the best free pair again and again gives.

    A pair that is the best of both its sides is taken by that rule whatever else
    happens, so each round takes all such pairs at once; ties go to the smaller ids.
    """
    left = cut_lineage(scored.where(F.col("score") >= least).select("a", "b", "score"))
    taken = left.limit(0)
    while True:
        order = [F.col("score").desc(), F.col("a"), F.col("b")]
        best_a = F.row_number().over(Window.partitionBy("a").orderBy(*order))
        best_b = F.row_number().over(Window.partitionBy("b").orderBy(*order))
        now = cut_lineage(left.withColumn("i", best_a).withColumn("j", best_b).where("i = 1 and j = 1").select("a", "b", "score"))
        if now.isEmpty():
            return taken
        taken = taken.unionByName(now)
        left = cut_lineage(left.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti"))
