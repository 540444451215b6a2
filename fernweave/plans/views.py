"""Views over the test tables that the reference queries share, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.operators import rules
from fernweave.operators.rules import GAME_RULES
from fernweave.session import table

#: Start of the period after the change under study, in epoch seconds: 2025-06-01.
BOUNDARY = 1748736000
#: Length of the compared periods in seconds: 60 days.
SPAN = 60 * 86400


def reviews(spark: SparkSession, sf_dir: str, around: bool = False) -> DataFrame:
    """Game reviews with flat names: one row per delivery; with `around` only those of the compared periods, tested on the stored column so that the scan can skip."""
    rows = table(spark, sf_dir, "game_reviews")
    if around:
        rows = rows.where((F.col("timestamp_created") >= BOUNDARY - SPAN) & (F.col("timestamp_created") <= BOUNDARY + SPAN))
    return rows.select(
        F.col("row_id").alias("seq"),
        F.col("recommendationid").alias("review_id"),
        F.col("appid").alias("product_id"),
        "language",
        F.col("review").alias("text"),
        F.lower(F.coalesce("review", F.lit(""))).alias("low"),
        F.col("voted_up").alias("positive"),
        "votes_up",
        F.when(F.col("timestamp_created") > 0, F.col("timestamp_created")).alias("created"),
        F.when(F.coalesce("primarily_steam_deck", F.lit(False)), "handheld").otherwise("desktop").alias("platform"),
        F.col("author.playtime_forever").alias("playtime"),
        F.col("weighted_vote_score").alias("score"),
    )


def analysed(spark: SparkSession, sf_dir: str, around: bool = False) -> DataFrame:
    """Reviews with topics, sentiment and request sign."""
    low = F.col("low")
    return (
        reviews(spark, sf_dir, around)
        .withColumn("topics", rules.topics_of(low, GAME_RULES))
        .withColumn("sentiment", rules.sentiment_of(low, GAME_RULES, F.col("positive")))
        .withColumn("request", rules.hit(low, GAME_RULES.requests))
    )


def _any(terms) -> str:
    quoted = (t.replace("'", "''") for t in terms)
    return "(" + " OR ".join(f"contains(low, '{t}')" for t in quoted) + ")"


_TOPICS = ", ".join(f"CASE WHEN {_any(terms)} THEN '{topic}' END" for topic, terms in GAME_RULES.topics.items())

REVIEWS_SQL = """rev AS (
  SELECT row_id AS seq, recommendationid AS review_id, appid AS product_id, language, review AS text, lower(coalesce(review, '')) AS low,
         voted_up AS positive, votes_up, CASE WHEN timestamp_created > 0 THEN timestamp_created END AS created,
         CASE WHEN coalesce(primarily_steam_deck, false) THEN 'handheld' ELSE 'desktop' END AS platform,
         author.playtime_forever AS playtime, weighted_vote_score AS score
  FROM game_reviews)"""

ANALYSED_SQL = f"""{REVIEWS_SQL}, ana AS (
  SELECT *, list_filter([{_TOPICS}], lambda x: x IS NOT NULL) AS topics,
         CASE WHEN {_any(GAME_RULES.positive)} AND {_any(GAME_RULES.negative)} THEN 'mixed' WHEN {_any(GAME_RULES.positive)} OR positive IS TRUE THEN 'positive'
              WHEN {_any(GAME_RULES.negative)} OR positive IS FALSE THEN 'negative' ELSE 'neutral' END AS sentiment,
         {_any(GAME_RULES.requests)} AS request
  FROM rev)"""

TOPICS_SQL = f"{ANALYSED_SQL}, top AS (SELECT * EXCLUDE (topics), unnest(topics) AS topic FROM ana)"
