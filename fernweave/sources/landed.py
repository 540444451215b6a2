"""Readers of landed payloads: review pages, news feeds, app feeds and directories of JSON.

Nothing is fetched; a payload is a string column of a table that a crawler has landed. A
payload that can't be parsed becomes a row with `error`, never a failed run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.operators.delivery import first_copies

REVIEW = "recommendationid: string, language: string, review: string, timestamp_created: bigint, timestamp_updated: bigint, voted_up: boolean, votes_up: int"
NEWS = "appnews struct<appid: int, newsitems: array<struct<gid: string, title: string, url: string, is_external_url: boolean, feedlabel: string, date: bigint, contents: string>>>"


def review_pages(pages: DataFrame, payload: str, order: Sequence[str]) -> DataFrame:
    """(`seq` parts, review columns, `error`): reviews of landed pages in page order, each id once; a page that can't be read as one row with `error`."""
    schema = f"success int, cursor string, reviews array<struct<{REVIEW}>>"
    parsed = pages.withColumn("_page", F.from_json(F.col(payload), schema, {"mode": "PERMISSIVE"}))
    bad = F.col("_page").isNull() | F.col("_page.reviews").isNull()
    listed = parsed.where(~bad).select(*order, F.posexplode("_page.reviews").alias("_k", "_r")).select(*order, F.col("_k").alias("place"), "_r.*", F.lit(None).cast("string").alias("error"))
    known = first_copies(listed.where(F.col("recommendationid").isNotNull() & (F.col("recommendationid") != "")), ["recommendationid"], [*[F.col(c) for c in order], F.col("place")])
    failed = parsed.where(bad).select(*order, F.lit("PAYLOAD_UNREADABLE").alias("error"))
    return known.unionByName(failed, allowMissingColumns=True)


def news_items(feeds: DataFrame, payload: str, most: int = 20) -> DataFrame:
    """One row per news item of a landed feed: id, time, title and whether it left the first-party site; at most `most` of a feed."""
    parsed = feeds.select(F.from_json(F.col(payload), NEWS).alias("p")).select("p.appnews.appid", F.posexplode("p.appnews.newsitems").alias("place", "n"))
    outside = F.coalesce(F.col("n.is_external_url"), F.lit(False)) & ~F.coalesce(F.col("n.url").contains("community_announcements"), F.lit(False))
    return parsed.where(F.col("place") < most).select(
        "appid",
        "place",
        F.coalesce("n.gid", "n.url", "n.title").alias("news_id"),
        "n.title",
        "n.url",
        F.when(F.col("n.date") > 0, F.timestamp_seconds("n.date")).alias("published_at"),
        outside.alias("external"),
    )


def app_feed(feeds: DataFrame, payload: str) -> DataFrame:
    """Reviews of a landed app feed whose values are wrapped in labels; only whole ratings from 1 to 5."""
    label = "struct<label: string>"
    schema = f"feed struct<entry: array<struct<id: {label}, title: {label}, content: {label}, updated: {label}, rating: {label}, version: {label}>>>"
    parsed = feeds.select(F.from_json(F.col(payload), schema).alias("p")).select(F.posexplode("p.feed.entry").alias("place", "e"))
    rating = F.col("e.rating.label").try_cast("int")
    review_id = F.coalesce(F.nullif(F.regexp_extract("e.id.label", r"[?&]id=(\d+)", 1), F.lit("")), F.regexp_extract("e.id.label", r"([^/]+)/?$", 1))
    return parsed.where(rating.between(1, 5)).select(
        "place", review_id.alias("review_id"), F.col("e.title.label").alias("title"), F.col("e.content.label").alias("text"), rating.alias("rating"), F.col("e.version.label").alias("version"), F.col("e.updated.label").alias("updated")
    )


def json_directory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON files of a folder, arrays as rows, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def previous_snapshot(spark: SparkSession, path: str | None, schema: str, record_type: str) -> DataFrame:
    """Rows of one record type of an earlier run, or none without a path."""
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col("record_type") == record_type)
