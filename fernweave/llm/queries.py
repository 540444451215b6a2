"""Queries over the test tables for the text and record problems, with SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm import addresses, encoding, language, leakage, lookalikes, matching, survivors, truncation
from fernweave.session import table


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews grouped by game and dishes grouped by restaurant; the group begins with the table's name."""
    asked = (("game_reviews", "row_id", "appid", "review"), ("menu_items", "item_id", "restaurantId", "nameOriginal"))
    reviews, dishes = (
        table(spark, sf_dir, t).select(F.col(i).alias("id"), F.concat(F.lit(f"{t}|"), F.col(g).cast("string")).alias("grp"), F.lit(t).alias("source_table"), F.col(c).alias("text")) for t, i, g, c in asked
    )
    return reviews.unionByName(dishes)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of reviews of one game, and of dishes of one restaurant, that look the same but differ in characters."""
    found = lookalikes.alike_pairs(_spelled(spark, sf_dir), "id", "grp", "text")
    return found.select(F.substring_index("grp", "|", 1).alias("source_table"), "id_a", "id_b")


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every review and dish name in its one form."""
    found = lookalikes.canonical_forms(_spelled(spark, sf_dir), "id", "source_table", "text")
    return found.select(F.col("grp").alias("source_table"), "id", "canonical")


def _directory(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select(
        F.col("lead_id").alias("id"),
        F.col("firmName").alias("name"),
        F.transform("locations", lambda x: x["city"]).alias("cities"),
        "domain",
        F.col("phoneNumbers").alias("phones"),
        F.transform("sourceRecords", lambda x: x["profileUrl"]).alias("urls"),
        F.transform("sourceRecords", lambda x: x["locationQuery"]).alias("queries"),
    )


def p2_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a xero and a quickbooks record of one firm in one town, with a confidence."""
    found = matching.match_directories(_directory(spark, sf_dir, "xero_firms"), _directory(spark, sf_dir, "quickbooks_firms"))
    return found.select(F.col("id_a").alias("lead_id_a"), F.col("id_b").alias("lead_id_b"), "confidence")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of `p2_scored`."""
    return p2_scored(spark, sf_dir).select("lead_id_a", "lead_id_b")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of venues at the same postal address."""
    venues = table(spark, sf_dir, "venues")
    found = addresses.same_address(venues, "venue_id", F.col("location.address"), F.col("location.city"), F.col("location.postalCode"))
    return found.select(F.col("id_a").alias("venue_id_a"), F.col("id_b").alias("venue_id_b"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of reviews with a missing or wrong label or a mixed text."""
    found = language.mislabelled(table(spark, sf_dir, "game_reviews"), "row_id", "language", "review")
    return found.select(F.col("id").alias("row_id"), "lang")


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language and confidence of each review, or of each segment of a mixed one."""
    found = language.languages(table(spark, sf_dir, "game_reviews"), "row_id", "language", "review")
    return found.select(F.col("id").alias("row_id"), "segment", "begin", "end", "lang", "confidence")


def _contacts() -> dict:
    website, phone, place = F.col("contact.website"), F.col("contact.phone"), F.col("sourceBusiness.placeId")
    return {
        "website": (website, survivors.usable_website(website)),
        "phone": (phone, survivors.usable_phone(phone)),
        "placeId": (place, survivors.usable_place_id(place)),
    }


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row whose website, phone and place identifier survive for each restaurant with several rows."""
    rows = table(spark, sf_dir, "restaurants")
    found = survivors.survivors(rows, "restaurantId", "row_id", F.col("sourceBusiness.scrapedAt"), _contacts())
    return found.select(F.col("g").alias("restaurantId"), "field_name", "row_id")


def p7_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surviving values of every restaurant, values without time being ordered by what timestamped rows teach."""
    rows = table(spark, sf_dir, "restaurants")
    found = survivors.survivors(rows, "restaurantId", "row_id", F.col("sourceBusiness.scrapedAt"), _contacts(), least_rows=1, learn_untimed=True)
    return found.select(F.col("g").alias("restaurantId"), "field_name", "row_id", "value")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encoding.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the test items they contain and the words of the longest stretch."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of `p9_leaks`."""
    return p9_leaks(spark, sf_dir).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut off."""
    found = truncation.cut_texts(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return found.where("cut").select(F.col("id").alias("doc_id"))


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts each source has, how many of them it cut, and at how many of its field limits."""
    documents = table(spark, sf_dir, "documents")
    return truncation.cut_by_source(documents, "doc_id", "text", "source")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_canonical, p2_found, p2_scored, p3_found, p6_found, p6_languages, p7_found, p7_learned, p8_ids, p9_found, p9_leaks, p10_found, p10_sources)
}
