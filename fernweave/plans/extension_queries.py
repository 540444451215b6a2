"""Relational extensions over the star schema and the event table: grouping sets, frames, as-of and interval joins, sessions, payloads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fernweave.operators import joins
from fernweave.plans.catalog import Catalog
from fernweave.session import table
from fernweave.sources import landed
from fernweave.streaming import feedback

query = Catalog()

_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _cents():
    return F.round(F.col("l_extendedprice") * 100).cast("long")


@query(f"SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(sum({_CENTS}) AS BIGINT) AS cents, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def ext_pricing_summary(spark, sf_dir):
    """Lines by flag and status."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.sum(_cents()).alias("cents"), F.count(F.lit(1)).alias("lines"))


@query(f"""SELECT n_name, CAST(sum({_CENTS}) AS BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def ext_local_suppliers(spark, sf_dir):
    """Turnover by nation where customer and supplier share it."""
    lines, orders, customers, suppliers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = (
        lines.select("l_orderkey", "l_suppkey", "l_extendedprice")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers.select("s_suppkey", "s_nationkey"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("n_name").agg(F.sum(_cents()).alias("cents"))


@query("""SELECT o_orderpriority, count(*) AS orders FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1""")
def ext_semi_join(spark, sf_dir):
    """Orders with a returned line, by priority."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(returned, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def ext_anti_join(spark, sf_dir):
    """Customers without orders."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(spark, sf_dir):
    """Orders along two dimensions and all their sums."""
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("o_orderstatus", "o_orderpriority").alias("level"))


@query("SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def ext_rollup(spark, sf_dir):
    """Customers by region and nation with subtotals."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS a, count(*) FILTER (user_id % 3 = 1) AS b, count(*) FILTER (user_id % 3 = 2) AS c FROM events GROUP BY 1")
def ext_pivot(spark, sf_dir):
    """Events by type with one column for each user group."""
    rows = table(spark, sf_dir, "events").withColumn("g", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("user_id") % 3 + 1).cast("int")))
    return rows.groupBy("event_type").pivot("g", ["a", "b", "c"]).agg(F.count(F.lit(1))).fillna(0)


@query("SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap_us, row_number() OVER w AS place, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def ext_frames(spark, sf_dir):
    """Gap to a user's last event, its place, and how many lie in the frame before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros("ts")
    return _events(spark, sf_dir).select("event_id", (at - F.lag(at).over(w)).alias("gap_us"), F.row_number().over(w).alias("place"), F.count(F.lit(1)).over(w.rowsBetween(-4, 0)).alias("recent"))


_VIEWS = "SELECT user_id, epoch_us(ts) AS t, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2"


@query(f"""WITH v AS ({_VIEWS}), p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase')
  SELECT p.event_id, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t""")
def ext_as_of_join(spark, sf_dir):
    """Each purchase with the user's latest view before it."""
    rows = _events(spark, sf_dir).withColumn("t", F.unix_micros("ts"))
    views = rows.where("event_type = 'view'").groupBy("user_id", "t").agg(F.max("event_id").alias("view_id"))
    bought = rows.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    return joins.as_of(bought, views, ["user_id"], "t", "t", ["view_id"], slice_width=7 * 86_400_000_000).select("event_id", "view_id")


@query("""WITH w AS (SELECT user_id, event_id AS signup_id, epoch_us(ts) AS a, epoch_us(ts) + 86400000000 AS b FROM events WHERE event_type = 'signup')
  SELECT w.signup_id, count(*) AS n FROM events e JOIN w ON e.user_id = w.user_id AND epoch_us(e.ts) >= a AND epoch_us(e.ts) < b GROUP BY 1""")
def ext_interval_join(spark, sf_dir):
    """Events of a user within a day after each sign-up."""
    rows = _events(spark, sf_dir).withColumn("t", F.unix_micros("ts"))
    spans = rows.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("t").alias("a"), (F.col("t") + 86_400_000_000).alias("b"))
    met = joins.in_intervals(rows.select("user_id", "t"), spans, ["user_id"], "t", "a", "b", 86_400_000_000)
    return met.groupBy("signup_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 1800000000 THEN 1 ELSE 0 END AS fresh FROM events),
  s AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(t) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_sessions(spark, sf_dir):
    """Sessions of users that end after half an hour without events."""
    found = feedback.session_counts(_events(spark, sf_dir), "ts", "30 minutes", ["user_id"], "1 hour")
    return found.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("""SELECT (epoch_us(ts) // 3600000000) * 3600000000 AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def ext_tumbling_windows(spark, sf_dir):
    """Events by type in windows of an hour, by the function that also runs on streams."""
    found = feedback.window_counts(_events(spark, sf_dir), "ts", "1 hour", ["event_type"], "2 hours")
    return found.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def ext_json_properties(spark, sf_dir):
    """A value inside the JSON of each event."""
    return _events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def ext_set_operations(spark, sf_dir):
    """Customers in credit with orders, none of them pending."""
    orders = table(spark, sf_dir, "orders")
    credit = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return credit.intersect(orders.select("o_custkey")).subtract(orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("""SELECT recommendationid, appid, language, timestamp_updated, voted_up, votes_up FROM game_reviews WHERE recommendationid IS NOT NULL AND recommendationid <> '' QUALIFY row_number() OVER (PARTITION BY recommendationid ORDER BY appid, row_id) = 1""")
def src_3_review_pages(spark, sf_dir):
    """Reviews read back from landed JSON pages, each id once."""
    fields = ["recommendationid", "language", "review", "timestamp_created", "timestamp_updated", "voted_up", "votes_up"]
    body = F.struct(F.lit(1).alias("success"), F.lit("c").alias("cursor"), F.array(F.struct(*fields)).alias("reviews"))
    pages = table(spark, sf_dir, "game_reviews").select("appid", "row_id", F.to_json(body).alias("payload"))
    found = landed.review_pages(pages, "payload", ["appid", "row_id"]).where(F.col("error").isNull())
    return found.select("recommendationid", "appid", "language", "timestamp_updated", "voted_up", "votes_up")
