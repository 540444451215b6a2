"""Feedback analysis: classification, counts, periods, rankings, clusters and contracts over game reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernweave.functions import numbers
from fernweave.operators import aggregates, delivery, joins, periods, quality, ranking
from fernweave.plans.catalog import Catalog
from fernweave.plans.views import ANALYSED_SQL, BOUNDARY, REVIEWS_SQL, SPAN, TOPICS_SQL, analysed, reviews

query = Catalog()
_AROUND = f"created >= {BOUNDARY - SPAN} AND created <= {BOUNDARY + SPAN}"
_PERIOD = f"CASE WHEN created >= {BOUNDARY - SPAN} AND created < {BOUNDARY} THEN 'before' WHEN created >= {BOUNDARY} AND created <= {BOUNDARY + SPAN} THEN 'after' END"

_HASH = (
    "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN 55296 + ((unicode(c) - 65536) >> 10) ELSE unicode(c) END::BIGINT)), "
    "lambda a, b: ((a * 31 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 + b)"
)


def _topics(spark, sf_dir, around=False):
    return analysed(spark, sf_dir, around).withColumn("topic", F.explode("topics"))


def _periods(rows):
    return rows.withColumn("period", periods.period_of(F.col("created"), BOUNDARY, SPAN)).where(F.col("period").isNotNull())


# Rows


@query("""SELECT row_id AS seq, recommendationid AS review_id, appid AS product_id,
  CASE WHEN timestamp_created > 0 THEN strftime(to_timestamp(timestamp_created) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') END AS created_iso,
  coalesce(author.num_games_owned, 0) AS games, coalesce(author.playtime_forever, 0) AS playtime, coalesce(weighted_vote_score, 0) AS score,
  CASE WHEN primarily_steam_deck IS NULL THEN 'unknown' WHEN primarily_steam_deck THEN 'yes' ELSE 'no' END AS deck
  FROM game_reviews""")
def prj_1_review_rows(spark, sf_dir):
    """Delivered reviews as typed rows: times as ISO text, missing numbers as zero, three-valued flags kept."""
    from fernweave.session import table

    rows = table(spark, sf_dir, "game_reviews")
    created = F.when(F.col("timestamp_created") > 0, F.date_format(F.timestamp_seconds("timestamp_created"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    deck = F.when(F.col("primarily_steam_deck").isNull(), "unknown").when(F.col("primarily_steam_deck"), "yes").otherwise("no")
    return rows.select(
        F.col("row_id").alias("seq"),
        F.col("recommendationid").alias("review_id"),
        F.col("appid").alias("product_id"),
        created.alias("created_iso"),
        F.coalesce("author.num_games_owned", F.lit(0)).alias("games"),
        F.coalesce("author.playtime_forever", F.lit(0)).alias("playtime"),
        F.coalesce("weighted_vote_score", F.lit(0.0)).alias("score"),
        deck.alias("deck"),
    )


# Filters


@query(f"WITH {REVIEWS_SQL} SELECT seq FROM rev WHERE {_AROUND} AND positive")
def flt_1_date_range(spark, sf_dir):
    """Positive reviews in a date range; a review without time isn't in it."""
    return reviews(spark, sf_dir, True).where("positive").select("seq")


@query(f"WITH {REVIEWS_SQL} SELECT seq, {_PERIOD} AS period FROM rev WHERE {_PERIOD} IS NOT NULL")
def flt_6_period(spark, sf_dir):
    """The period of each review around the boundary."""
    return _periods(reviews(spark, sf_dir, True)).select("seq", "period")


@query(f"""WITH {TOPICS_SQL}, c AS (SELECT product_id, topic, count(*) FILTER (created < {BOUNDARY}) AS before, count(*) FILTER (created >= {BOUNDARY}) AS after,
    count(*) FILTER (created < {BOUNDARY} AND sentiment = 'negative') AS negative_before, count(*) FILTER (created >= {BOUNDARY} AND sentiment = 'negative') AS negative_after
    FROM top WHERE {_AROUND} GROUP BY 1, 2),
  t AS (SELECT product_id, count(*) FILTER (created < {BOUNDARY}) AS n_before, count(*) FILTER (created >= {BOUNDARY}) AS n_after FROM rev WHERE {_AROUND} GROUP BY 1),
  r AS (SELECT *, CASE WHEN n_before > 0 THEN before / n_before ELSE 0 END AS rb, CASE WHEN n_after > 0 THEN after / n_after ELSE 0 END AS ra,
    CASE WHEN after > 0 THEN negative_after / after ELSE 0 END AS sa, CASE WHEN before > 0 THEN negative_before / before ELSE 0 END AS sb FROM c JOIN t USING (product_id))
  SELECT product_id, topic, before, after, rb <= 0.05 AND ra >= 0.12 AND after >= 3 AND sa >= 0.6 AS new_issue, round(ra - rb, 12) >= 0.08 AND after >= 3 AND sa >= 0.6 AS regression,
    negative_before >= 3 AND round(sb - sa, 12) >= 0.08 AS improvement FROM r""")
def flt_14_change_signs(spark, sf_dir):
    """New issues, regressions and improvements of topics by thresholds on rates and negative shares."""
    rows = _periods(analysed(spark, sf_dir, True))
    before, negative = F.col("period") == "before", F.col("sentiment") == "negative"
    counts = rows.withColumn("topic", F.explode("topics")).groupBy("product_id", "topic").agg(
        F.count_if(before).alias("before"), F.count_if(~before).alias("after"), F.count_if(before & negative).alias("negative_before"), F.count_if(~before & negative).alias("negative_after")
    )
    totals = rows.groupBy("product_id").agg(F.count_if(before).alias("n_before"), F.count_if(~before).alias("n_after"))
    return periods.detected(counts.join(totals, "product_id")).select("product_id", "topic", "before", "after", "new_issue", "regression", "improvement")


# Joins


@query(f"""WITH {REVIEWS_SQL}, last AS (SELECT review_id, votes_up FROM rev WHERE review_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY seq DESC) = 1)
  SELECT rev.seq, coalesce(last.votes_up, 0) AS last_votes FROM rev LEFT JOIN last USING (review_id)""")
def jn_1_last_match(spark, sf_dir):
    """Each delivery with the votes of the last delivery of its review."""
    rows = reviews(spark, sf_dir)
    right = rows.where(F.col("review_id").isNotNull()).select("review_id", "seq", F.col("votes_up").alias("last_votes"))
    return joins.with_match(rows.select("seq", "review_id"), right, ["review_id"], "seq", last=True, defaults={"last_votes": 0}).select("seq", "last_votes")


@query(f"""WITH {TOPICS_SQL}, b AS (SELECT product_id, topic, count(*) AS n FROM top WHERE created >= {BOUNDARY - SPAN} AND created < {BOUNDARY} GROUP BY 1, 2),
  a AS (SELECT product_id, topic, count(*) AS n FROM top WHERE created >= {BOUNDARY} AND created <= {BOUNDARY + SPAN} GROUP BY 1, 2)
  SELECT product_id, topic, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after FROM b FULL JOIN a USING (product_id, topic)""")
def jn_4_both_periods(spark, sf_dir):
    """Topic counts of both periods, zero where a period lacks the topic."""
    counted = _periods(_topics(spark, sf_dir, True)).groupBy("product_id", "topic", "period").agg(F.count(F.lit(1)).alias("n"))
    return joins.both_sides(counted.where("period = 'before'"), counted.where("period = 'after'"), ["product_id", "topic"], ["n"])


@query(f"""WITH {TOPICS_SQL} SELECT DISTINCT product_id, topic FROM top a WHERE created >= {BOUNDARY} AND created <= {BOUNDARY + SPAN}
  AND NOT EXISTS (SELECT 1 FROM top b WHERE b.product_id = a.product_id AND b.topic = a.topic AND b.created >= {BOUNDARY - SPAN} AND b.created < {BOUNDARY})""")
def jn_5_only_after(spark, sf_dir):
    """Topics of a product that appear only after the boundary."""
    counted = periods.compared(_periods(_topics(spark, sf_dir, True)), ["product_id", "topic"])
    return counted.where("before = 0").select("product_id", "topic")


@query(f"""WITH {TOPICS_SQL}, p AS (SELECT product_id, topic, platform, count(*) AS n FROM top WHERE sentiment = 'negative' GROUP BY 1, 2, 3)
  SELECT product_id, topic, d.n AS desktop, h.n AS handheld FROM p d JOIN p h USING (product_id, topic) WHERE d.platform = 'desktop' AND h.platform = 'handheld'""")
def jn_6_shared_topics(spark, sf_dir):
    """Negative topics that a product has on both platforms."""
    rows = _topics(spark, sf_dir).where("sentiment = 'negative'")
    counted = rows.groupBy("product_id", "topic").agg(F.count_if(F.col("platform") == "desktop").alias("desktop"), F.count_if(F.col("platform") == "handheld").alias("handheld"))
    return counted.where("desktop > 0 and handheld > 0")


@query(f"""WITH {REVIEWS_SQL}, o AS (SELECT review_id, votes_up, positive, language FROM rev WHERE review_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY seq) = 1),
  n AS (SELECT review_id, votes_up, positive, language FROM rev WHERE review_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY seq DESC) = 1),
  j AS (SELECT review_id, o.votes_up AS a1, n.votes_up AS b1, o.positive AS a2, n.positive AS b2, o.language AS a3, n.language AS b3 FROM o JOIN n USING (review_id))
  SELECT review_id, 'votes_up' AS field, CAST(a1 AS VARCHAR) AS old, CAST(b1 AS VARCHAR) AS new FROM j WHERE a1 IS DISTINCT FROM b1
  UNION ALL SELECT review_id, 'positive', CAST(a2 AS VARCHAR), CAST(b2 AS VARCHAR) FROM j WHERE a2 IS DISTINCT FROM b2
  UNION ALL SELECT review_id, 'language', a3, b3 FROM j WHERE a3 IS DISTINCT FROM b3""")
def jn_15_mismatches(spark, sf_dir):
    """Fields in which the first and the last delivery of a review differ."""
    rows = reviews(spark, sf_dir).where(F.col("review_id").isNotNull()).select("review_id", "seq", "votes_up", "positive", "language")
    first, last = joins.one_per_key(rows, ["review_id"], "seq"), joins.one_per_key(rows, ["review_id"], "seq", last=True)
    return joins.mismatches(first, last, "review_id", ["votes_up", "positive", "language"])


# Aggregates


@query(f"WITH {REVIEWS_SQL} SELECT product_id, language AS value, count(*) AS n, min(seq) AS first_seq FROM rev WHERE language IS NOT NULL AND language <> '' GROUP BY 1, 2")
def agg_1_distribution(spark, sf_dir):
    """How often each label occurs for a product, and where first."""
    return aggregates.distribution(reviews(spark, sf_dir), ["product_id"], F.col("language"), "seq")


@query(f"""WITH {ANALYSED_SQL} SELECT product_id, count(*) AS collected, count(*) FILTER (low <> '') AS analysed, count(*) FILTER (len(topics) > 0) AS actionable,
  count(*) FILTER (positive) AS positive, count(*) FILTER (sentiment = 'negative') AS negative, sum(votes_up) AS votes, min(created) AS first_at, max(created) AS last_at FROM ana GROUP BY 1""")
def agg_2_report(spark, sf_dir):
    """Counts of a product's report."""
    return analysed(spark, sf_dir).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("collected"),
        F.count_if(F.col("low") != "").alias("analysed"),
        F.count_if(F.size("topics") > 0).alias("actionable"),
        F.count_if("positive").alias("positive"),
        F.count_if(F.col("sentiment") == "negative").alias("negative"),
        F.sum("votes_up").alias("votes"),
        F.min("created").alias("first_at"),
        F.max("created").alias("last_at"),
    )


@query(f"""WITH {TOPICS_SQL}, c AS (SELECT product_id, topic, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative FROM top GROUP BY 1, 2)
  SELECT * FROM c WHERE positive + negative > 0 QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY positive + negative DESC, topic) <= 5""")
def agg_6_topic_stats(spark, sf_dir):
    """The five most mentioned topics of each product by sentiment."""
    counted = _topics(spark, sf_dir).groupBy("product_id", "topic").agg(
        F.count_if(F.col("sentiment") == "positive").alias("positive"), F.count_if(F.col("sentiment") == "negative").alias("negative")
    ).where("positive + negative > 0")
    return ranking.top_per_key(counted, ["product_id"], [(F.col("positive") + F.col("negative")).desc(), F.col("topic")], 5).drop("rank")


@query(f"""WITH {TOPICS_SQL}, p AS (SELECT *, {_PERIOD} AS period FROM top), c AS (SELECT period, topic, count(*) AS mentions, count(*) FILTER (sentiment = 'negative') AS negative FROM p WHERE period IS NOT NULL GROUP BY 1, 2),
  e AS (SELECT period, topic, seq FROM p WHERE period IS NOT NULL QUALIFY row_number() OVER (PARTITION BY period, topic ORDER BY seq) <= 2)
  SELECT c.*, array_to_string((SELECT list(seq ORDER BY seq) FROM e WHERE e.period = c.period AND e.topic = c.topic), ',') AS evidence FROM c""")
def agg_9_period_themes(spark, sf_dir):
    """Mentions of themes in each period with the first two reviews as evidence."""
    rows = _periods(_topics(spark, sf_dir, True))
    counted = rows.groupBy("period", "topic").agg(F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("sentiment") == "negative").alias("negative"))
    two = ranking.top_per_key(rows.select("period", "topic", "seq"), ["period", "topic"], [F.col("seq")], 2)
    listed = two.groupBy("period", "topic").agg(F.array_join(F.array_sort(F.collect_list("seq")).cast("array<string>"), ",").alias("evidence"))
    return counted.join(listed, ["period", "topic"])


@query(f"""WITH {REVIEWS_SQL} SELECT product_id, string_agg(language || '=' || n, ',' ORDER BY language) AS languages FROM
  (SELECT product_id, language, count(*) AS n FROM rev WHERE language IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def agg_10_language_map(spark, sf_dir):
    """Counts by label of recommending and other reviews of each product, added as maps."""
    rows = reviews(spark, sf_dir).where(F.col("language").isNotNull())
    votes = F.coalesce(F.col("positive"), F.lit(False))
    halves = rows.groupBy("product_id", "language").agg(F.count_if(votes).alias("a"), F.count_if(~votes).alias("b"))
    maps = halves.groupBy("product_id").agg(
        F.map_from_entries(F.collect_list(F.struct("language", "a"))).alias("a"), F.map_from_entries(F.collect_list(F.struct("language", "b"))).alias("b")
    )
    both = F.array_sort(F.map_entries(aggregates.added_maps(F.col("a"), F.col("b"))))
    return maps.select("product_id", F.array_join(F.transform(both, lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("languages"))


@query(f"""WITH {ANALYSED_SQL} SELECT language, platform, count(*) AS reviews, count(*) FILTER (positive) AS positive, count(*) FILTER (len(topics) > 0) AS actionable,
  CASE WHEN count(*) < 8 THEN 'low_sample' ELSE 'ok' END AS evidence FROM ana WHERE language IS NOT NULL GROUP BY 1, 2""")
def agg_11_dimensions(spark, sf_dir):
    """Counts by label and platform with a warning for small samples."""
    counted = analysed(spark, sf_dir).where(F.col("language").isNotNull()).groupBy("language", "platform").agg(
        F.count(F.lit(1)).alias("reviews"), F.count_if("positive").alias("positive"), F.count_if(F.size("topics") > 0).alias("actionable")
    )
    return counted.withColumn("evidence", F.when(F.col("reviews") < 8, "low_sample").otherwise("ok"))


@query(f"""WITH {REVIEWS_SQL}, d AS (SELECT 'language' AS dimension, language AS key, created FROM rev UNION ALL SELECT 'platform', platform, created FROM rev)
  SELECT dimension, key, count(*) FILTER (created < {BOUNDARY}) AS before, count(*) FILTER (created >= {BOUNDARY}) AS after FROM d WHERE {_AROUND} AND key IS NOT NULL GROUP BY 1, 2""")
def agg_13_impact(spark, sf_dir):
    """Counts of both periods along several dimensions at once."""
    rows = _periods(reviews(spark, sf_dir, True)).select("period", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("key")) for d in ("language", "platform")])).alias("d"))
    return periods.compared(rows.select("period", "d.*").where(F.col("key").isNotNull()), ["dimension", "key"]).select("dimension", "key", "before", "after")


@query(f"""WITH {ANALYSED_SQL}, l AS (SELECT seq, len(topics) > 0 AS found, positive IS FALSE AS wanted FROM ana)
  SELECT count(*) FILTER (found) AS found, count(*) FILTER (wanted) AS wanted, count(*) FILTER (found AND wanted) AS both,
  count(*) FILTER (found AND wanted) / count(*) FILTER (found) AS precision, count(*) FILTER (found AND wanted) / count(*) FILTER (wanted) AS recall FROM l""")
def agg_24_quality(spark, sf_dir):
    """Precision and recall of reviews with an issue topic against reviews voted down."""
    rows = analysed(spark, sf_dir)
    return aggregates.precision_recall(rows.where(F.size("topics") > 0), rows.where(~F.col("positive")), ["seq"])


# Periods


@query(f"""WITH {TOPICS_SQL}, c AS (SELECT product_id, topic, count(*) FILTER (created < {BOUNDARY}) AS before, count(*) FILTER (created >= {BOUNDARY}) AS after FROM top WHERE {_AROUND} GROUP BY 1, 2)
  SELECT *, after - before AS change, CASE WHEN after > before THEN 'increased' WHEN after < before THEN 'decreased' ELSE 'unchanged' END AS direction FROM c""")
def win_3_topic_changes(spark, sf_dir):
    """Which topics of each product grew or shrank after the boundary."""
    return periods.compared(_periods(_topics(spark, sf_dir, True)), ["product_id", "topic"])


@query(f"""WITH {REVIEWS_SQL}, c AS (SELECT product_id, count(*) FILTER (created < {BOUNDARY}) AS n_before, count(*) FILTER (created >= {BOUNDARY}) AS n_after,
    count(*) FILTER (created < {BOUNDARY} AND positive) AS positive_before, count(*) FILTER (created >= {BOUNDARY} AND positive) AS positive_after FROM rev WHERE {_AROUND} GROUP BY 1),
  d AS (SELECT *, round(positive_after / n_after - positive_before / n_before, 12) AS x FROM c)
  SELECT product_id, n_before, n_after, positive_before, positive_after, CASE WHEN n_before < 8 OR n_after < 8 THEN 'insufficient_data' WHEN x <= -0.1 THEN 'much_worse' WHEN x <= -0.04 THEN 'worse'
    WHEN x < 0.04 THEN 'stable' WHEN x < 0.1 THEN 'better' ELSE 'much_better' END AS direction FROM d""")
def win_4_sentiment_shift(spark, sf_dir):
    """Direction of each product's positive rate over the boundary."""
    return periods.sentiment_shift(_periods(reviews(spark, sf_dir, True)), ["product_id"], F.col("positive"))


@query(f"""WITH {REVIEWS_SQL}, p AS (SELECT *, {_PERIOD} AS period FROM rev), c AS (SELECT product_id, period, count(*) AS n, min(created) AS first_at, max(created) AS last_at FROM p WHERE period IS NOT NULL GROUP BY 1, 2)
  SELECT *, CASE WHEN n < 8 THEN 'insufficient' WHEN first_at <= CASE period WHEN 'before' THEN {BOUNDARY - SPAN} ELSE {BOUNDARY} END + 86400 THEN 'full' ELSE 'partial' END AS status FROM c""")
def win_7_coverage(spark, sf_dir):
    """How far each product's periods are covered."""
    return periods.coverage(_periods(reviews(spark, sf_dir, True)), ["product_id"], "created", BOUNDARY, SPAN)


@query(f"""WITH {TOPICS_SQL}, b AS (SELECT product_id, min(created) + 30 * 86400 AS edge FROM rev WHERE created IS NOT NULL GROUP BY 1)
  SELECT product_id, topic, count(*) FILTER (created < edge) AS before, count(*) FILTER (created >= edge) AS after FROM top JOIN b USING (product_id)
  WHERE created >= edge - {SPAN} AND created <= edge + {SPAN} GROUP BY 1, 2""")
def win_11_staggered(spark, sf_dir):
    """Topic counts around a boundary of each product's own."""
    rows = reviews(spark, sf_dir)
    edges = rows.where(F.col("created").isNotNull()).groupBy("product_id").agg((F.min("created") + 30 * 86400).alias("edge"))
    joined = _topics(spark, sf_dir).join(edges, "product_id").withColumn("period", periods.period_of(F.col("created"), F.col("edge"), SPAN)).where(F.col("period").isNotNull())
    return periods.compared(joined, ["product_id", "topic"]).select("product_id", "topic", "before", "after")


# Rankings


@query(f"""WITH {TOPICS_SQL}, c AS (SELECT product_id, topic, count(*) AS n FROM top GROUP BY 1, 2)
  SELECT product_id, topic, n, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, topic) AS rank FROM c QUALIFY rank <= 3""")
def srt_1_top_topics(spark, sf_dir):
    """The three most mentioned topics of each product."""
    counted = _topics(spark, sf_dir).groupBy("product_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    return ranking.top_per_key(counted, ["product_id"], [F.col("n").desc(), F.col("topic")], 3)


@query(f"""WITH {REVIEWS_SQL}, h AS (SELECT seq, review_id, product_id, abs({_HASH.format(x="'7|' || review_id")}) AS h FROM rev WHERE review_id IS NOT NULL AND seq IS NOT NULL),
  f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY product_id, review_id ORDER BY seq) = 1)
  SELECT product_id, review_id, h FROM f QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY h, review_id) <= 5""")
def srt_5_seeded_sample(spark, sf_dir):
    """Five reviews of each product by a seeded hash of their id, each id once."""
    rows = reviews(spark, sf_dir).where(F.col("review_id").isNotNull()).select("product_id", "review_id").distinct()
    sampled = ranking.seeded_sample(rows, ["product_id"], F.col("review_id"), 5, "7")
    return sampled.withColumn("h", numbers.polynomial_hash(F.concat(F.lit("7|"), F.col("review_id")))).select("product_id", "review_id", "h")


@query(f"""WITH {REVIEWS_SQL}, t AS (SELECT product_id, seq, row_number() OVER (PARTITION BY product_id ORDER BY votes_up DESC, seq) AS turn FROM rev)
  SELECT product_id, seq, turn FROM t ORDER BY turn, product_id LIMIT 500""")
def srt_8_round_robin(spark, sf_dir):
    """The first 500 reviews when products are served in turn."""
    rows = reviews(spark, sf_dir).select("product_id", "seq", "votes_up")
    return ranking.interleaved(rows, ["product_id"], [F.col("votes_up").desc_nulls_last(), F.col("seq")], [F.col("product_id")], 500).select("product_id", "seq", "turn")


# Contracts


@query(f"""WITH {REVIEWS_SQL} SELECT seq, array_to_string(list_filter([CASE WHEN NOT coalesce(review_id <> '', false) THEN 'id' END, CASE WHEN NOT coalesce(low <> '', false) THEN 'text' END,
  CASE WHEN NOT coalesce(created > 0, false) THEN 'created' END, CASE WHEN NOT coalesce(score BETWEEN 0 AND 1, false) THEN 'score' END], lambda x: x IS NOT NULL), ',') AS violations FROM rev""")
def val_1_contract(spark, sf_dir):
    """The rules of the feedback contract that each review breaks."""
    rules = {"id": F.col("review_id") != "", "text": F.col("low") != "", "created": F.col("created") > 0, "score": F.col("score").between(0, 1)}
    return quality.with_violations(reviews(spark, sf_dir), rules).select("seq", F.array_join("violations", ",").alias("violations"))


@query(f"WITH {REVIEWS_SQL} SELECT review_id, count(*) AS n FROM rev WHERE review_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def val_6_duplicate_ids(spark, sf_dir):
    """Review ids that occur more than once."""
    return quality.duplicate_ids(reviews(spark, sf_dir).where(F.col("review_id").isNotNull()), ["review_id"])


@query("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_partkey IS NOT NULL)""")
def val_6_dangling(spark, sf_dir):
    """Parts that no large order line refers to."""
    from fernweave.session import table

    large = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= 49).select(F.col("l_partkey").alias("p_partkey"))
    return quality.dangling(table(spark, sf_dir, "part"), large, "p_partkey").select("p_partkey")


@query(f"WITH {REVIEWS_SQL} SELECT seq, abs({_HASH.format(x='text')}) AS h FROM rev WHERE text <> ''")
def sc_27_polynomial_hash(spark, sf_dir):
    """The base-31 hash of each review's text."""
    rows = reviews(spark, sf_dir).where("text <> ''")
    return rows.select("seq", numbers.polynomial_hash(F.col("text")).alias("h"))


@query(f"""WITH {REVIEWS_SQL} SELECT product_id, seq FROM rev WHERE review_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY seq) = 1
  AND TRUE""")
def src_2_first_seen(spark, sf_dir):
    """Collected pages without repeated ids: each review where it is first seen."""
    rows = reviews(spark, sf_dir).select("product_id", "seq", "review_id")
    return delivery.first_copies(rows, ["review_id"], [F.col("seq")], keep_null_keys=False).select("product_id", "seq")
