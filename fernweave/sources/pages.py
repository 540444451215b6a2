"""Landed web pages: structured data, links and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.functions.text import html_to_text
from fernweave.functions.web import host_of


def json_ld(html: Column) -> Column:
    """The JSON of all structured-data scripts of a page."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))


def products(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Offers of structured product data: name, amount, currency, availability."""
    schema = "`@type` string, name string, isbn string, offers struct<price: string, priceCurrency: string, availability: string>, `@graph` array<string>"
    found = pages.select(url, F.explode(json_ld(F.col(html))).alias("j")).select(url, F.from_json("j", schema).alias("p"), "j")
    nested = found.where(F.col("p.`@graph`").isNotNull()).select(url, F.explode("p.`@graph`").alias("j")).select(url, F.from_json("j", schema).alias("p"), "j")
    both = found.unionByName(nested).where(F.lower("p.`@type`").isin("product", "book"))
    return both.select(
        url, F.col("p.name").alias("name"), F.col("p.isbn").alias("isbn"), F.col("p.offers.price").try_cast("double").alias("amount"), F.col("p.offers.priceCurrency").alias("currency"),
        F.regexp_extract("p.offers.availability", r"([^/]+)$", 1).alias("availability"),
    )


def links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(`url`, `href`, `label`, `same_host`): anchors of a page, each target once."""
    anchor = r"(?is)(<a\b[^>]*href=[\"'][^\"'#]+[\"'][^>]*>.*?</a>)"
    each = pages.select(url, F.explode(F.regexp_extract_all(html, F.lit(anchor), F.lit(1))).alias("a"))
    href = F.regexp_extract("a", r"(?is)href=[\"']([^\"'#]+)[\"']", 1)
    out = each.select(url, href.alias("href"), html_to_text(F.col("a")).alias("label")).dropDuplicates([url, "href"])
    local = ~F.col("href").rlike(r"^[a-z][a-z0-9+.-]*:") | (host_of(F.col("href")) == host_of(F.col(url)))
    return out.withColumn("same_host", F.coalesce(local, F.lit(False)))


def page_status(status: Column, content_type: Column) -> Column:
    """What a fetched page is: page, document, other, missing, blocked or failed."""
    return (
        F.when(status.isNull() | (status >= 500), "failed")
        .when(status.isin(401, 403, 429), "blocked")
        .when(status.between(400, 499), "missing")
        .when(content_type.contains("html"), "page")
        .when(content_type.contains("pdf"), "document")
        .otherwise("other")
    )
