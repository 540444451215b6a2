"""Feedback by the full rule tables: analysis, issues, wishes, clusters and platform matches; services and completeness of firms."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernweave.functions import text
from fernweave.operators import clustering, patterns, periods, review_analysis
from fernweave.operators.rules import GAME_RULES
from fernweave.plans.catalog import Catalog
from fernweave.plans.views import BOUNDARY, REVIEWS_SQL, SPAN, reviews
from fernweave.session import cut_lineage, table

query = Catalog()
R = review_analysis


def _quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def _names(words) -> str:
    return "[" + ", ".join(map(_quoted, words)) + "]"


_FLAGS = {
    "positive": GAME_RULES.positive, "negative": GAME_RULES.negative, "request": GAME_RULES.requests, "issue": R.ISSUE_TERMS, "critical": R.CRITICAL_TERMS, "slots": R.SAVE_SLOT_TERMS,
}
_TERMS = ", ".join(
    f"({_quoted(kind)}, {_quoted(name)}, {pos}, {_quoted(term)})"
    for kind, groups in (("topic", GAME_RULES.topics), ("flag", _FLAGS), ("trigger", R.TRIGGERS), ("case", {"platform": R.PLATFORM_TERMS, "joke": R.JOKE_TERMS}))
    for pos, (name, terms) in enumerate(groups.items())
    for term in terms
)
_TYPES = ", ".join(f"({pos + 2}, {_quoted(t)}, {_quoted(topic)})" for pos, (t, topics) in enumerate(R.TYPE_TOPICS.items()) for topic in topics)
_TITLE_SQL = " ".join(
    f"WHEN len(list_intersect(topics, {_names(names)})) {'>= 1' if mode == 'any' else f'= {len(names)}'} THEN {_quoted(words)}" for names, mode, words in R.TITLES
)
_PRIMARY_SQL = "CASE " + " ".join(f"WHEN list_contains(types, {_quoted(t)}) THEN {_quoted(t)}" for t in R.PRIMARY) + " ELSE 'nonActionable' END"

#: The analysis as a join of reviews with the rule tables as rows.
RULED_SQL = f"""{REVIEWS_SQL}, src AS (SELECT *, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS whole FROM rev),
  terms(kind, name, pos, term) AS (VALUES {_TERMS}), by_topic(pos, type, topic) AS (VALUES {_TYPES}),
  hits AS (SELECT DISTINCT seq, kind, name, pos FROM src JOIN terms ON contains(CASE WHEN kind = 'case' THEN whole ELSE lower(whole) END, term)),
  tops AS (SELECT seq, list(name ORDER BY pos) FILTER (kind = 'topic') AS topics, list(name) FILTER (kind = 'flag') AS flags, list(name ORDER BY pos) FILTER (kind = 'trigger') AS signs, list(name) FILTER (kind = 'case') AS cases FROM hits GROUP BY 1),
  a1 AS (SELECT src.*, coalesce(topics, []) AS topics, coalesce(flags, []) AS flags, coalesce(signs, []) AS signs, coalesce(cases, []) AS cases FROM src LEFT JOIN tops USING (seq)),
  a2 AS (SELECT *, list_contains(flags, 'positive') AS good, list_contains(flags, 'negative') AS bad, list_contains(flags, 'request') AS request,
    list_contains(flags, 'issue') OR list_has_any(topics, {_names(R.ISSUE_TOPICS)}) AS issue, list_filter(signs, lambda x: x <> 'opening the inventory' OR list_contains(topics, 'inventory')) AS triggers FROM a1),
  shown AS (SELECT seq, 0 AS pos, 'featureRequest' AS type FROM a2 WHERE request UNION ALL SELECT seq, 1, 'bugReport' FROM a2 WHERE issue
    UNION ALL SELECT DISTINCT seq, by_topic.pos, type FROM hits JOIN by_topic ON hits.kind = 'topic' AND hits.name = by_topic.topic
    UNION ALL SELECT seq, 90, 'positiveFeedback' FROM a2 WHERE good AND NOT bad UNION ALL SELECT seq, 91, 'generalComplaint' FROM a2 WHERE bad AND NOT issue AND NOT request),
  listed AS (SELECT seq, list(type ORDER BY pos) AS types FROM shown GROUP BY 1),
  a3 AS (SELECT a2.*, coalesce(types, ['nonActionable']) AS types, CASE WHEN good AND bad THEN 'mixed' WHEN good OR positive IS TRUE THEN 'positive' WHEN bad OR positive IS FALSE THEN 'negative' ELSE 'neutral' END AS sentiment FROM a2 LEFT JOIN listed USING (seq)),
  a4 AS (SELECT *, {_PRIMARY_SQL} AS primary_type, CASE WHEN list_contains(flags, 'critical') THEN 'critical' WHEN list_has_any(topics, ['crashes', 'freezes']) OR list_contains(types, 'performanceIssue') THEN 'high'
    WHEN list_has_any(types, ['bugReport', 'controllerIssue', 'localizationIssue']) THEN 'medium' ELSE 'unknown' END AS severity,
    CASE WHEN length(whole) < 10 THEN 8 ELSE greatest(0, least(100, 5 + CASE WHEN length(whole) >= 30 THEN 18 ELSE 0 END + CASE WHEN len(topics) > 0 THEN 28 ELSE 0 END + CASE WHEN list_has_any(types, {_names(R.SCORED_TYPES)}) THEN 25 ELSE 0 END
      + CASE WHEN len(triggers) > 0 OR list_contains(cases, 'platform') THEN 18 ELSE 0 END - CASE WHEN list_contains(cases, 'joke') THEN 15 ELSE 0 END)) END / 100 AS points FROM a3),
  ruled AS (SELECT *, points >= 0.45 AS actionable, CASE WHEN list_has_any(types, {_names(R.ISSUE_TYPES)}) THEN CASE {_TITLE_SQL} WHEN len(topics) > 0 THEN 'Reported problem with ' || topics[1]
      ELSE coalesce(nullif(trim(substr(whole, 1, {R.TITLE_CHARS})), ''), 'Reported player concern') END END AS title,
    CASE WHEN primary_type = 'featureRequest' THEN CASE WHEN list_contains(flags, 'slots') THEN 'manual save slots' ELSE 'Improve ' || coalesce(topics[1], 'the game experience') END END AS request_title FROM a4)"""
_PERIOD = f"CASE WHEN created >= {BOUNDARY - SPAN} AND created < {BOUNDARY} THEN 'before' WHEN created >= {BOUNDARY} AND created <= {BOUNDARY + SPAN} THEN 'after' END"


def _ruled(spark, sf_dir, around=False):
    return review_analysis.analyse(reviews(spark, sf_dir, around), "text", "positive")


def _joined(*names):
    return [F.array_join(n, ",").alias(n) for n in names]


@query(f"""WITH {RULED_SQL} SELECT seq, array_to_string(topics, ',') AS topics, array_to_string(types, ',') AS types, primary_type, sentiment, severity, array_to_string(triggers, ',') AS triggers, points, actionable, title, request_title FROM ruled""")
def cls_1_review_analysis(spark, sf_dir):
    """Topics, types, sentiment, severity, triggers, actionability and titles of each review by the rule tables."""
    return _ruled(spark, sf_dir).select("seq", *_joined("topics", "types"), "primary_type", "sentiment", "severity", *_joined("triggers"), "points", "actionable", "title", "request_title")


_WISH_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '(?i)(?:^|[^A-Za-z0-9_]){w}([^\\n\\r]+)', 1), '')" for w in patterns.WISHES) + ")"
_TOPIC_ROWS = ", ".join(f"({pos}, {_quoted(t)}, {_quoted(words)})" for pos, (t, words) in enumerate(patterns.GAME_TOPICS.items()))
_WISHED_SQL = f"trim(regexp_replace(substr(trim(regexp_replace({_WISH_SQL}, '\\s+', ' ', 'g')), 1, {patterns.WISH_CHARS}), '[.!?]+$', ''))"


@query(f"WITH {REVIEWS_SQL} SELECT seq, {_WISHED_SQL} AS wish FROM rev WHERE {_WISH_SQL} IS NOT NULL")
def cls_2_wishes(spark, sf_dir):
    """What reviews ask for, by the first of nine ways of asking."""
    return reviews(spark, sf_dir).select("seq", patterns.wish_in(F.col("text")).alias("wish")).where(F.col("wish").isNotNull())


@query(f"""WITH {REVIEWS_SQL}, words(pos, topic, words) AS (VALUES {_TOPIC_ROWS}), t AS (SELECT seq, list(topic ORDER BY pos) AS topics FROM rev JOIN words ON regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])(?:' || words || ')(?:[^A-Za-z0-9_]|$)') GROUP BY 1),
  a AS (SELECT rev.seq, positive, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS size, coalesce(topics, []) AS topics, {_WISH_SQL} IS NOT NULL AS wish FROM rev LEFT JOIN t USING (seq)),
  b AS (SELECT *, len(list_filter(topics, lambda x: x NOT IN ('content', 'gameplay'))) > 0 AS issue FROM a)
  SELECT seq, array_to_string(topics, ',') AS topics, CASE WHEN wish THEN 'featureRequest' WHEN list_contains(topics, 'crashes_stability') THEN 'stabilityIssue' WHEN list_contains(topics, 'performance') THEN 'performanceIssue' WHEN issue THEN 'bugReport'
    WHEN positive IS TRUE THEN 'positiveFeedback' WHEN size < 10 THEN 'nonActionable' ELSE 'generalComplaint' END AS primary_type, CASE WHEN wish THEN 'low' WHEN list_contains(topics, 'crashes_stability') THEN 'high' WHEN issue THEN 'medium' ELSE 'unknown' END AS severity,
    CASE WHEN wish THEN 0.75 WHEN issue THEN 0.7 WHEN size >= 30 THEN 0.2 ELSE 0.08 END::DOUBLE AS score FROM b""")
def cls_3_game_taxonomy(spark, sf_dir):
    """Reviews by the word patterns of game topics: topics, first type, severity and score."""
    rows = reviews(spark, sf_dir).withColumn("topics", patterns.topics_in(F.coalesce("text", F.lit("")))).withColumn("wish", patterns.wish_in(F.col("text")).isNotNull())
    issue = F.size(F.array_except("topics", F.array(F.lit("content"), F.lit("gameplay")))) > 0
    size = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    has = lambda t: F.array_contains("topics", t)
    first = (
        F.when(F.col("wish"), "featureRequest").when(has("crashes_stability"), "stabilityIssue").when(has("performance"), "performanceIssue").when(issue, "bugReport")
        .when(F.coalesce("positive", F.lit(False)), "positiveFeedback").when(size < 10, "nonActionable").otherwise("generalComplaint")
    )
    severity = F.when(F.col("wish"), "low").when(has("crashes_stability"), "high").when(issue, "medium").otherwise("unknown")
    score = F.when(F.col("wish"), 0.75).when(issue, 0.7).when(size >= 30, 0.2).otherwise(0.08)
    return rows.select("seq", *_joined("topics"), first.alias("primary_type"), severity.alias("severity"), score.alias("score"))


_RANK_SQL = "CASE severity WHEN 'unknown' THEN -1 WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


def _rank():
    return F.when(F.col("severity") == "unknown", -1).when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)


@query(f"WITH {RULED_SQL} SELECT product_id, title, count(*) AS mentions, arg_min(severity, {_RANK_SQL}) AS severity, min(seq) AS first_seq FROM ruled WHERE title IS NOT NULL GROUP BY 1, 2")
def agg_3_issues(spark, sf_dir):
    """Mentions of each issue title of a product with its severity; an unknown one comes before all others."""
    rows = _ruled(spark, sf_dir).where(F.col("title").isNotNull())
    return rows.groupBy("product_id", "title").agg(F.count(F.lit(1)).alias("mentions"), F.min_by("severity", _rank()).alias("severity"), F.min("seq").alias("first_seq"))


@query(f"""WITH {RULED_SQL}, w AS (SELECT product_id, request_title AS wish, {_PERIOD} AS period FROM ruled WHERE request_title IS NOT NULL)
  SELECT product_id, wish, count(*) FILTER (period = 'before') AS before, count(*) FILTER (period = 'after') AS after FROM w WHERE period IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (period = 'after') > 0""")
def jn_7_wishes(spark, sf_dir):
    """Wishes of each product by period, those still made after the boundary."""
    rows = _ruled(spark, sf_dir, True).where(F.col("request_title").isNotNull())
    rows = rows.select("product_id", F.col("request_title").alias("wish"), periods.period_of(F.col("created"), BOUNDARY, SPAN).alias("period")).where(F.col("period").isNotNull())
    return periods.compared(rows, ["product_id", "wish"]).where("after > 0").select("product_id", "wish", "before", "after")


def _groups(spark, sf_dir):
    """Issue titles of a product, platform and type: united topics (of nineteen, so few sets), mentions, gravest severity."""
    rows = _ruled(spark, sf_dir).where(F.col("title").isNotNull() & (F.size("topics") > 0))
    keys = ["product_id", "platform", "primary_type", "title"]
    rank = F.when(F.col("severity") == "unknown", 9).otherwise(_rank())
    topics = F.array_sort(F.array_distinct(F.flatten(F.collect_set("topics")))).alias("topics")
    mentions = rows.groupBy(*keys).agg(topics, F.count(F.lit(1)).alias("mentions"), F.min_by("severity", rank).alias("severity"), F.min("created").alias("first_at"), F.max("created").alias("last_at"))
    return mentions.withColumn("tokens", clustering.tokens(F.col("title")))


_GROUPS_SQL = f"""{RULED_SQL}, g0 AS (SELECT * FROM ruled WHERE title IS NOT NULL AND len(topics) > 0),
  g1 AS (SELECT product_id, platform, primary_type, title, list_sort(list(DISTINCT topic)) AS topics FROM (SELECT *, unnest(topics) AS topic FROM g0) GROUP BY 1, 2, 3, 4),
  g2 AS (SELECT product_id, platform, primary_type, title, count(*) AS mentions, arg_min(severity, CASE severity WHEN 'unknown' THEN 9 ELSE {_RANK_SQL} END) AS severity FROM g0 GROUP BY 1, 2, 3, 4),
  grp AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda t: length(t) > 2)) AS tokens FROM g1 JOIN g2 USING (product_id, platform, primary_type, title))"""


def _overlap_sql(x: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat(a.{x}, b.{x}))) = 0 THEN 0 ELSE len(list_intersect(a.{x}, b.{x})) / len(list_distinct(list_concat(a.{x}, b.{x}))) END"


def _platform_scores(spark, sf_dir):
    groups = cut_lineage(_groups(spark, sf_dir))
    keys = ["product_id", "primary_type"]
    sides = [groups.where(F.col("platform") == p).select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("title", "topics", "tokens", "severity", "mentions")]) for s, p in (("a", "desktop"), ("b", "handheld"))]
    shared = [d.withColumn("t", F.explode(F.array_union(F.transform(f"topics_{s}", lambda x: F.concat(F.lit("#"), x)), F.col(f"tokens_{s}")))) for s, d in zip("ab", sides)]
    met = shared[0].join(shared[1], [*keys, "t"]).drop("t").dropDuplicates([*keys, "title_a", "title_b"])
    return clustering.platform_score(met)


@query(f"""WITH {_GROUPS_SQL}, p AS (SELECT a.product_id, a.primary_type, a.title AS title_a, b.title AS title_b, {_overlap_sql('topics')} AS t, {_overlap_sql('tokens')} AS w,
    CASE WHEN a.severity = b.severity THEN 1 WHEN a.severity = 'unknown' OR b.severity = 'unknown' THEN 0.7 ELSE 0.4 END AS s FROM grp a JOIN grp b ON a.product_id = b.product_id AND a.primary_type = b.primary_type AND a.platform = 'desktop' AND b.platform = 'handheld')
  SELECT product_id, primary_type, title_a, title_b, round(100 * (t * 0.5 + w * 0.4 + s * 0.1) + 1e-9)::BIGINT AS hundredths FROM p WHERE t > 0 OR w > 0""")
def er_5_platform_scores(spark, sf_dir):
    """Scores of issue groups of both platforms: topics half, title words two fifths, severity a tenth."""
    return _platform_scores(spark, sf_dir).select("product_id", "primary_type", "title_a", "title_b", "hundredths")


@query()
def jn_9_platform_matches(spark, sf_dir):
    """One-to-one matches of issue groups of a product on both platforms, best scores first, from .75 on; with the platform that has twice the mentions."""
    scored = _platform_scores(spark, sf_dir)
    scored = scored.withColumn("a", F.xxhash64("product_id", "primary_type", "title_a")).withColumn("b", F.xxhash64("product_id", "primary_type", "title_b")).withColumn("score", F.col("hundredths") / 100)
    best = clustering.greedy_pairs(scored, clustering.SHARED_SCORE).select("a", "b")
    return scored.join(best, ["a", "b"]).select("product_id", "primary_type", "title_a", "title_b", "score", clustering.dominance("mentions_a", "mentions_b").alias("classification"))


@query()
def jn_10_one_platform_only(spark, sf_dir):
    """Issue groups of one platform without a match on the other, and whether their mentions are evidence."""
    matched = jn_9_platform_matches(spark, sf_dir)
    groups = _groups(spark, sf_dir)
    out = []
    for s, p in (("a", "desktop"), ("b", "handheld")):
        mine = groups.where(F.col("platform") == p)
        lone = mine.join(matched.select("product_id", "primary_type", F.col(f"title_{s}").alias("title")), ["product_id", "primary_type", "title"], "left_anti")
        out.append(lone.select("product_id", "platform", "primary_type", "title", "mentions", F.when(F.col("mentions") < clustering.LEAST_MENTIONS, "insufficientEvidence").otherwise(f"{p}Only").alias("classification")))
    return out[0].unionByName(out[1])


@query(f"""WITH {_GROUPS_SQL} SELECT a.product_id, a.platform, a.primary_type, a.title AS title_a, b.title AS title_b FROM grp a JOIN grp b USING (product_id, platform, primary_type)
  WHERE a.title < b.title AND ({_overlap_sql('topics')} >= 0.5 OR {_overlap_sql('tokens')} >= 0.5)""")
def er_4_title_similarity(spark, sf_dir):
    """Pairs of issue groups of a product, platform and type that share half of their topics or title words."""
    groups, pairs = _similar(spark, sf_dir)
    shown = ["product_id", "platform", "primary_type"]
    joined = pairs.join(groups.select(F.col("id").alias("a"), *shown, F.col("title").alias("ta")), "a").join(groups.select(F.col("id").alias("b"), F.col("title").alias("tb")), "b")
    return joined.select(*shown, F.least("ta", "tb").alias("title_a"), F.greatest("ta", "tb").alias("title_b"))


def _similar(spark, sf_dir):
    block = ["product_id", "platform", "primary_type"]
    groups = cut_lineage(_groups(spark, sf_dir).withColumn("id", F.xxhash64(*block, "title")))
    by_words = clustering.similar_titles(groups.where(F.size("tokens") > 0), block)
    by_topics = clustering.similar_titles(groups.withColumn("tokens", F.col("topics")), block)
    return groups, by_words.unionByName(by_topics).distinct()


@query()
def er_1_issue_clusters(spark, sf_dir):
    """Clusters of similar issues of a product, platform and type: smallest title, united topics, gravest severity, mentions, first and last time."""
    groups, pairs = _similar(spark, sf_dir)
    joined = groups.join(clustering.components(groups, pairs), "id")
    keys = ["product_id", "platform", "primary_type", "root"]
    topics = joined.select(*keys, F.explode("topics").alias("topic")).distinct().groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("topic")), ",").alias("topics"))
    rank = F.when(F.col("severity") == "unknown", 9).otherwise(_rank())
    out = joined.groupBy(*keys).agg(
        F.min("title").alias("canonical"), F.count(F.lit(1)).alias("titles"), F.sum("mentions").alias("mentions"), F.min_by("severity", rank).alias("severity"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )
    return out.join(topics, keys).withColumn("cluster_id", F.concat(F.lit("issue-"), text.slug(F.col("canonical")), F.lit("-"), F.col("platform"))).drop("root")


# Firms


def _mapped_sql(column: str, rules) -> str:
    rows = ", ".join(f"({pos}, {_quoted(p)}, {_quoted(n)})" for pos, (p, n) in enumerate(rules))
    return f"""WITH r(pos, pattern, name) AS (VALUES {rows}), l AS (SELECT lead_id, unnest({column}) AS label, generate_subscripts({column}, 1) AS k FROM xero_firms),
  m AS (SELECT lead_id, name, min(k * 1000 + pos) AS place FROM l JOIN r ON regexp_matches(label, '(?i)' || pattern) GROUP BY 1, 2)
  SELECT xero_firms.lead_id, coalesce(string_agg(name, ',' ORDER BY place), '') AS names FROM xero_firms LEFT JOIN m USING (lead_id) GROUP BY 1"""


def _mapped(spark, sf_dir, column, rules):
    return table(spark, sf_dir, "xero_firms").select("lead_id", F.coalesce(F.array_join(patterns.mapped(F.col(column), rules), ","), F.lit("")).alias("names"))


@query(_mapped_sql("services", patterns.SERVICES))
def cls_9_services(spark, sf_dir):
    """The services that the labels of each firm stand for."""
    return _mapped(spark, sf_dir, "services", patterns.SERVICES)


@query(_mapped_sql("industriesServed", patterns.INDUSTRIES))
def cls_9_industries(spark, sf_dir):
    """The industries that the labels of each firm stand for."""
    return _mapped(spark, sf_dir, "industriesServed", patterns.INDUSTRIES)


def _has_sql(column: str) -> str:
    return f"coalesce(len({column}) > 0, false)"


@query(f"""SELECT lead_id, least(100, 5 * (coalesce(firmName, '') <> '')::INT + 10 * {_has_sql('sourceRecords')}::INT + 15 * (coalesce(website, '') <> '' OR coalesce(domain, '') <> '')::INT + 15 * {_has_sql('emails')}::INT + 10 * {_has_sql('phoneNumbers')}::INT
  + 10 * (len(list_filter(coalesce(locations, []), lambda l: coalesce(l.address, '') <> '' AND coalesce(l.city, '') <> '' AND coalesce(l.countryCode, '') <> '')) > 0)::INT + 10 * {_has_sql('services')}::INT + 5 * {_has_sql('industriesServed')}::INT
  + 5 * (len(list_filter(coalesce(advisorNames, []), lambda n: coalesce(n, '') <> '')) > 0)::INT + 5 * (coalesce(descriptionOriginal, '') <> '')::INT)::INT AS completeness FROM xero_firms""")
def cls_13_completeness(spark, sf_dir):
    """How complete each firm's record is: eleven parts, of which certifications aren't in the table."""
    def said(c):
        return F.coalesce(c, F.lit("")) != ""

    def some(c):
        return F.coalesce(F.size(c) > 0, F.lit(False))

    placed = F.exists("locations", lambda x: said(x["address"]) & said(x["city"]) & said(x["countryCode"]))
    parts = (
        (said(F.col("firmName")), 5), (some("sourceRecords"), 10), (said(F.col("website")) | said(F.col("domain")), 15), (some("emails"), 15), (some("phoneNumbers"), 10), (F.coalesce(placed, F.lit(False)), 10),
        (some("services"), 10), (some("industriesServed"), 5), (F.coalesce(F.exists("advisorNames", said), F.lit(False)), 5), (said(F.col("descriptionOriginal")), 5),
    )
    total = sum((F.when(test, n).otherwise(0) for test, n in parts), F.lit(0))
    return table(spark, sf_dir, "xero_firms").select("lead_id", F.least(F.lit(100), total).alias("completeness"))
