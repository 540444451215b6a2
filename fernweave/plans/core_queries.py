"""Queries for redelivered messages and nearby points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.operators import delivery, nearby
from fernweave.session import table

NEAR_METRES = 50.0


def _latest_first() -> list:
    return [F.col("timestamp_updated").desc_nulls_last(), F.col("received_at").asc_nulls_last(), F.col("row_id").asc()]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of repeated deliveries to drop."""
    return delivery.repeated_copies(table(spark, sf_dir, "game_reviews"), ["recommendationid"], _latest_first(), "row_id")


def p4_new_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the deliveries since July that weren't stored before, each by its first arrival."""
    rows = table(spark, sf_dir, "game_reviews").select("row_id", "recommendationid", "received_at")
    cut = F.lit("2025-07-01").cast("timestamp")
    arrival = [F.col("received_at").asc_nulls_last(), F.col("row_id").asc()]
    found = delivery.new_messages(rows.where(F.col("received_at") < cut), rows.where(F.col("received_at") >= cut), ["recommendationid"], arrival)
    return found.select("recommendationid", "row_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of venues at most 50 metres apart."""
    found = nearby.near_pairs(table(spark, sf_dir, "venues"), "venue_id", F.col("location.latitude"), F.col("location.longitude"), NEAR_METRES)
    return found.select(F.col("id_a").alias("venue_id_a"), F.col("id_b").alias("venue_id_b"))


def p5_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core box of each town, one deviation around its mean point, that holds a venue."""
    venues = table(spark, sf_dir, "venues")
    lat, lon = F.col("location.latitude"), F.col("location.longitude")
    usable = venues.where(nearby.usable_coordinates(lat, lon) & F.col("location.city").isNotNull())
    box = usable.groupBy(F.col("location.city").alias("region")).agg(
        F.avg(lat).alias("y"), F.coalesce(F.stddev_samp(lat), F.lit(0.0)).alias("dy"), F.avg(lon).alias("x"), F.coalesce(F.stddev_samp(lon), F.lit(0.0)).alias("dx")
    )
    south, north = F.round(F.col("y") - F.col("dy"), 3) - 0.00005, F.round(F.col("y") + F.col("dy"), 3) + 0.00005
    west, east = F.round(F.col("x") - F.col("dx"), 3) - 0.00005, F.round(F.col("x") + F.col("dx"), 3) + 0.00005
    corners = [(west, south), (east, south), (east, north), (west, north)]
    regions = box.select("region", F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in corners]).alias("ring"))
    found = nearby.points_in_regions(venues, "venue_id", lat, lon, regions)
    return found.select(F.col("id").alias("venue_id"), "region")


QUERIES = {f.__name__: f for f in (p4_found, p4_new_messages, p5_found, p5_regions)}

_USABLE = "lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) AND NOT (lat = 0 AND lon = 0) AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"
_POINTS = f"SELECT venue_id, city, lat, lon FROM (SELECT venue_id, location.city AS city, location.latitude AS lat, location.longitude AS lon FROM venues) WHERE {_USABLE}"

ORACLE_SQL = {
    "p4_found": """
        SELECT row_id FROM game_reviews WHERE recommendationid IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY recommendationid ORDER BY timestamp_updated DESC NULLS LAST, received_at ASC NULLS LAST, row_id) > 1
    """,
    "p4_new_messages": """
        SELECT recommendationid, row_id FROM game_reviews b
        WHERE recommendationid IS NOT NULL AND received_at >= TIMESTAMP '2025-07-01'
          AND NOT EXISTS (SELECT 1 FROM game_reviews a WHERE a.recommendationid = b.recommendationid AND a.received_at < TIMESTAMP '2025-07-01')
        QUALIFY row_number() OVER (PARTITION BY recommendationid ORDER BY received_at ASC NULLS LAST, row_id) = 1
    """,
    "p5_found": f"""
        WITH p AS ({_POINTS})
        SELECT a.venue_id AS venue_id_a, b.venue_id AS venue_id_b FROM p a JOIN p b
          ON a.venue_id < b.venue_id AND b.lat BETWEEN a.lat - 0.00046 AND a.lat + 0.00046
        WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
              + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 50
    """,
    "p5_regions": f"""
        WITH p AS ({_POINTS}),
        box AS (SELECT city AS region, avg(lat) AS y, coalesce(stddev_samp(lat), 0) AS dy, avg(lon) AS x, coalesce(stddev_samp(lon), 0) AS dx
                FROM p WHERE city IS NOT NULL GROUP BY city)
        SELECT p.venue_id, b.region FROM p JOIN box b
          ON p.lat BETWEEN round(b.y - b.dy, 3) - 0.00005 AND round(b.y + b.dy, 3) + 0.00005
         AND p.lon BETWEEN round(b.x - b.dx, 3) - 0.00005 AND round(b.x + b.dx, 3) + 0.00005
    """,
}
