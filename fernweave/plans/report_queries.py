"""Reports, lookups, rankings and scalar expressions that complete the inventory, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernweave.functions import numbers, text, web
from fernweave.operators import clustering, joins, merging, periods, ranking, rules
from fernweave.plans.catalog import Catalog
from fernweave.plans.views import ANALYSED_SQL, BOUNDARY, REVIEWS_SQL, SPAN, TOPICS_SQL, analysed, reviews
from fernweave.session import table
from fernweave.sources import sinks

query = Catalog()
_PERIOD = f"CASE WHEN created >= {BOUNDARY - SPAN} AND created < {BOUNDARY} THEN 'before' WHEN created >= {BOUNDARY} AND created <= {BOUNDARY + SPAN} THEN 'after' END"


def _topics(spark, sf_dir, around=False):
    return analysed(spark, sf_dir, around).withColumn("topic", F.explode("topics"))


def _period():
    return periods.period_of(F.col("created"), BOUNDARY, SPAN)


# Sources and sinks


@query("""SELECT m.item_id, coalesce(r.restaurantName, 'unknown') AS name FROM menu_items m LEFT JOIN (SELECT restaurantId, restaurantName FROM restaurants QUALIFY row_number() OVER (PARTITION BY restaurantId ORDER BY row_id) = 1) r USING (restaurantId)""")
def src_5_dimension_lookup(spark, sf_dir):
    """Each dish with the name of its restaurant, or a default."""
    names = table(spark, sf_dir, "restaurants").select("restaurantId", "row_id", F.col("restaurantName").alias("name"))
    return joins.with_match(table(spark, sf_dir, "menu_items").select("item_id", "restaurantId"), names, ["restaurantId"], "row_id", defaults={"name": "unknown"}).select("item_id", "name")


@query(f"""WITH {REVIEWS_SQL} SELECT product_id, platform, count(*) AS rows, count(DISTINCT review_id) AS reviews, count(*) FILTER (text IS NULL) AS empty FROM rev GROUP BY 1, 2""")
def src_10_collection_counters(spark, sf_dir):
    """What was collected for each product and platform."""
    return reviews(spark, sf_dir).groupBy("product_id", "platform").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("review_id").alias("reviews"), F.count_if(F.col("text").isNull()).alias("empty"))


@query("""WITH v AS MATERIALIZED (SELECT venue_id, source.placeId AS place, contact.website IS NOT NULL AS has_site, coalesce(source.discoveryPlatform, 'none') AS platform FROM venues)
  SELECT venue_id, has_site, platform FROM v WHERE place IS NOT NULL QUALIFY row_number() OVER (PARTITION BY place ORDER BY venue_id) = 1""")
def src_17_listing_cards(spark, sf_dir):
    """Listings by place identifier, each once."""
    rows = table(spark, sf_dir, "venues").where(F.col("source.placeId").isNotNull())
    cards = rows.select(F.col("source.placeId").alias("place"), "venue_id", F.col("contact.website").isNotNull().alias("has_site"), F.coalesce("source.discoveryPlatform", F.lit("none")).alias("platform"))
    return joins.one_per_key(cards, ["place"], "venue_id").select("venue_id", "has_site", "platform")


@query("""SELECT lead_id, regexp_replace(firmName, '[^A-Za-z0-9_-]', '_', 'g') AS report_key FROM quickbooks_firms""")
def snk_2_report_keys(spark, sf_dir):
    """Firm names as keys of a key-value store."""
    return table(spark, sf_dir, "quickbooks_firms").select("lead_id", sinks.report_key(F.col("firmName")).alias("report_key"))


# Rows


@query("""SELECT lead_id, locations[1].city AS city, locations[1].countryCode AS country, emails[1].email AS email, phoneNumbers[1] AS phone, list_contains(list_transform(sourceRecords, lambda x: x.source), 'xero') AS has_profile FROM xero_firms""")
def prj_9_primary_fields(spark, sf_dir):
    """First town, mail and telephone number of each firm and whether it has a profile."""
    def first(c):
        return F.try_element_at(c, F.lit(1))

    rows = table(spark, sf_dir, "xero_firms")
    place = first(F.col("locations"))
    return rows.select(
        "lead_id", place["city"].alias("city"), place["countryCode"].alias("country"), first(F.col("emails"))["email"].alias("email"), first(F.col("phoneNumbers")).alias("phone"),
        F.array_contains(F.transform("sourceRecords", lambda x: x["source"]), "xero").alias("has_profile"),
    )


@query("""SELECT row_id, CASE WHEN weighted_vote_score >= 0.7 THEN 'yes' WHEN weighted_vote_score <= 0.3 THEN 'no' ELSE NULL END AS signal, CASE WHEN review IS NULL THEN 'failed' ELSE 'success' END AS status FROM game_reviews""")
def prj_4_signals(spark, sf_dir):
    """A positive, negative or no signal by score, and the status of the row."""
    score = F.col("weighted_vote_score")
    return table(spark, sf_dir, "game_reviews").select(
        "row_id", F.when(score >= 0.7, "yes").when(score <= 0.3, "no").alias("signal"), F.when(F.col("review").isNull(), "failed").otherwise("success").alias("status")
    )


# Filters


@query(f"WITH {ANALYSED_SQL} SELECT seq FROM ana WHERE low <> '' AND len(topics) > 0 AND NOT request")
def flt_4_cluster_candidates(spark, sf_dir):
    """Reviews that may enter clusters: analysed, with a topic, no request."""
    return analysed(spark, sf_dir).where((F.col("low") != "") & (F.size("topics") > 0) & ~F.col("request")).select("seq")


@query("""SELECT lead_id FROM quickbooks_firms WHERE domain IS NOT NULL AND NOT regexp_matches(lower(domain), '(^|\\.)(facebook|instagram|linkedin|twitter|x|youtube|tiktok|pinterest|yelp)\\.com$|(^|\\.)(social|pages)\\.') AND NOT regexp_matches(lower(domain), '\\.(png|jpg|jpeg|gif|svg|webp)$')""")
def flt_10_blocked_hosts(spark, sf_dir):
    """Firms whose domain is neither a network of profiles nor the name of a picture."""
    domain = F.lower("domain")
    return table(spark, sf_dir, "quickbooks_firms").where(F.col("domain").isNotNull() & ~domain.rlike(rules.PROFILE_HOSTS) & ~domain.rlike(r"\.(png|jpg|jpeg|gif|svg|webp)$")).select("lead_id")


@query(r"""WITH h AS (SELECT row_id, contact.website AS u, lower(regexp_extract(contact.website, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM restaurants)
  SELECT row_id FROM h WHERE contains(host, '.') AND NOT regexp_matches(host, '^[0-9.]+$') AND NOT regexp_matches(host, '\.(local|localhost|internal|lan)$') AND NOT regexp_matches(u, '^[a-z]+://[^/]*@') AND host NOT IN ('www.', 'm.')""")
def flt_11_public_addresses(spark, sf_dir):
    """Records with a web address of a public name."""
    rows = table(spark, sf_dir, "restaurants").where(F.col("contact.website").rlike("^https?://"))
    return rows.where(web.public_host(F.col("contact.website"))).select("row_id")


@query("""SELECT r.row_id FROM restaurants r WHERE EXISTS (SELECT 1 FROM menu_items m WHERE m.restaurantId = r.restaurantId AND contains(m.sourceUrl, left(r.restaurantId, 10)))""")
def flt_13_own_site(spark, sf_dir):
    """Records of restaurants whose dishes were read from a site of their own."""
    own = table(spark, sf_dir, "menu_items").where(F.expr("contains(sourceUrl, left(restaurantId, 10))")).select("restaurantId")
    return table(spark, sf_dir, "restaurants").join(own, "restaurantId", "left_semi").select("row_id")


# Joins


@query(f"""WITH {TOPICS_SQL}, f AS (SELECT product_id, topic, min(seq) AS first_seq FROM top GROUP BY 1, 2) SELECT f.product_id, f.topic, rev.review_id FROM f JOIN rev ON rev.seq = f.first_seq""")
def jn_3_first_member(spark, sf_dir):
    """The review in which each topic of a product is first mentioned."""
    rows = _topics(spark, sf_dir).select("product_id", "topic", "seq", "review_id")
    return joins.one_per_key(rows, ["product_id", "topic"], "seq").select("product_id", "topic", "review_id")


@query(f"""WITH {TOPICS_SQL}, d AS (SELECT DISTINCT product_id, topic, platform FROM top)
  SELECT product_id, topic, platform || '_only' AS side FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.product_id = a.product_id AND b.topic = a.topic AND b.platform <> a.platform)""")
def jn_10_one_sided(spark, sf_dir):
    """Topics that a product has on one platform only."""
    counted = _topics(spark, sf_dir).groupBy("product_id", "topic").agg(F.min("platform").alias("a"), F.max("platform").alias("b"))
    return counted.where("a = b").select("product_id", "topic", F.concat("a", F.lit("_only")).alias("side"))


@query("""WITH p AS (SELECT restaurantId, row_id, restaurantName, location.city AS city FROM restaurants), b AS (SELECT restaurantId, restaurantName AS best FROM p QUALIFY row_number() OVER (PARTITION BY restaurantId ORDER BY row_id DESC) = 1)
  SELECT p.restaurantId, b.best AS name, count(*) AS agreeing, first(p.city ORDER BY p.row_id) FILTER (trim(p.city) <> '') AS city FROM p JOIN b ON p.restaurantId = b.restaurantId AND lower(p.restaurantName) = lower(b.best) GROUP BY 1, 2""")
def jn_13_agreeing_records(spark, sf_dir):
    """Records that agree with the last name of their restaurant, merged."""
    rows = table(spark, sf_dir, "restaurants").select("restaurantId", "row_id", "restaurantName", F.col("location.city").alias("city"))
    best = joins.one_per_key(rows.select("restaurantId", "row_id", F.col("restaurantName").alias("name")), ["restaurantId"], "row_id", last=True).drop("row_id")
    same = rows.join(best, "restaurantId").where(F.lower("restaurantName") == F.lower("name"))
    return same.groupBy("restaurantId", "name").agg(F.count(F.lit(1)).alias("agreeing"), merging.first_value(F.col("city"), F.col("row_id")).alias("city"))


# Counts


@query(f"WITH {ANALYSED_SQL} SELECT product_id, count(*) FILTER (request) AS requests, count(DISTINCT review_id) FILTER (request) AS reviews FROM ana GROUP BY 1 HAVING count(*) FILTER (request) > 0")
def agg_4_requests(spark, sf_dir):
    """Requests of each product."""
    rows = analysed(spark, sf_dir).where("request")
    return rows.groupBy("product_id").agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("review_id").alias("reviews"))


@query(f"WITH {TOPICS_SQL} SELECT language, topic, count(*) AS n FROM top WHERE topic IN ('interface', 'audio') AND language IS NOT NULL GROUP BY 1, 2")
def agg_5_by_language(spark, sf_dir):
    """Two topics by label."""
    return _topics(spark, sf_dir).where(F.col("topic").isin("interface", "audio") & F.col("language").isNotNull()).groupBy("language", "topic").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TOPICS_SQL}, c AS (SELECT product_id, topic, count(*) FILTER (sentiment = 'positive') AS p, count(*) FILTER (sentiment = 'negative') AS n, count(*) FILTER (sentiment = 'mixed') AS m, count(*) FILTER (sentiment = 'neutral') AS u FROM top GROUP BY 1, 2)
  SELECT product_id, topic, CASE WHEN p > n AND p >= m AND p >= u THEN 'positive' WHEN n > p AND n >= m AND n >= u THEN 'negative' WHEN m > u THEN 'mixed' ELSE 'neutral' END AS overall FROM c""")
def agg_14_majority(spark, sf_dir):
    """The prevailing sentiment of each topic of a product."""
    counts = [F.count_if(F.col("sentiment") == s).alias(a) for a, s in (("p", "positive"), ("n", "negative"), ("m", "mixed"), ("u", "neutral"))]
    overall = F.when(F.expr("p > n and p >= m and p >= u"), "positive").when(F.expr("n > p and n >= m and n >= u"), "negative").when(F.expr("m > u"), "mixed").otherwise("neutral")
    return _topics(spark, sf_dir).groupBy("product_id", "topic").agg(*counts).select("product_id", "topic", overall.alias("overall"))


@query("""SELECT platform, count(*) AS n, count(*) FILTER (placeId IS NULL) AS failed, max(t) AS last_us FROM (SELECT sourceBusiness.platform AS platform, sourceBusiness.placeId AS placeId, epoch_us(sourceBusiness.scrapedAt) AS t FROM restaurants) GROUP BY 1""")
def agg_21_source_summary(spark, sf_dir):
    """Records, failures and last time of each source."""
    rows = table(spark, sf_dir, "restaurants").select("sourceBusiness.*")
    return rows.groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("placeId").isNull()).alias("failed"), F.unix_micros(F.max("scrapedAt").cast("timestamp")).alias("last_us"))


@query("""WITH p AS (SELECT restaurantId, sourceUrl, count(price.amount) AS priced, min(item_id) AS first_item FROM menu_items GROUP BY 1, 2) SELECT restaurantId, sourceUrl, priced FROM p QUALIFY row_number() OVER (PARTITION BY restaurantId ORDER BY priced DESC, first_item) = 1""")
def agg_23_fullest_page(spark, sf_dir):
    """The page of each restaurant with the most amounts."""
    counted = table(spark, sf_dir, "menu_items").groupBy("restaurantId", "sourceUrl").agg(F.count("price.amount").alias("priced"), F.min("item_id").alias("first_item"))
    return ranking.top_per_key(counted, ["restaurantId"], [F.col("priced").desc(), F.col("first_item")], 1).select("restaurantId", "sourceUrl", "priced")


# Periods


@query(f"""WITH {TOPICS_SQL}, p AS (SELECT *, {_PERIOD} AS period FROM top), n AS (SELECT {_PERIOD} AS period, count(*) AS total FROM rev GROUP BY 1)
  SELECT topic, period, count(*) AS mentions, any_value(total) AS total FROM p JOIN n USING (period) WHERE period IS NOT NULL GROUP BY 1, 2""")
def win_5_theme_rates(spark, sf_dir):
    """Mentions of themes and all reviews of each period, as parts of rates."""
    rows = analysed(spark, sf_dir, True).withColumn("period", _period()).where(F.col("period").isNotNull())
    totals = rows.groupBy("period").agg(F.count(F.lit(1)).alias("total"))
    counted = rows.withColumn("topic", F.explode("topics")).groupBy("topic", "period").agg(F.count(F.lit(1)).alias("mentions"))
    return counted.join(totals, "period").select("topic", "period", "mentions", "total")


@query(f"""WITH {REVIEWS_SQL}, c AS (SELECT product_id, count(*) FILTER ({_PERIOD} = 'before') AS b, count(*) FILTER ({_PERIOD} = 'after') AS a, count(*) FILTER ({_PERIOD} = 'before' AND positive) AS pb, count(*) FILTER ({_PERIOD} = 'after' AND positive) AS pa FROM rev GROUP BY 1),
  q AS (SELECT *, least(1, least(b, a) / 40) AS sample, CASE WHEN least(b, a) < 8 THEN 0.25 ELSE 1 END AS covered, CASE WHEN b > 0 AND a > 0 THEN least(1, abs(pa / a - pb / b) / 0.1) ELSE 0 END AS shift FROM c),
  r AS (SELECT *, sample * 0.35 + covered * 0.35 + 0.8 * 0.2 + shift * 0.1 AS raw FROM q), s AS (SELECT product_id, round(CASE WHEN least(b, a) < 8 THEN least(raw, 0.39) ELSE raw END, 6)::DOUBLE AS confidence FROM r)
  SELECT product_id, confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS label FROM s""")
def win_6_confidence(spark, sf_dir):
    """A confidence from sample size, coverage, consistency and shift of each product's periods, capped where a period is thin."""
    p, positive = F.col("period"), F.coalesce("positive", F.lit(False))
    counted = reviews(spark, sf_dir).withColumn("period", _period()).groupBy("product_id").agg(
        F.count_if(p == "before").alias("b"), F.count_if(p == "after").alias("a"), F.count_if((p == "before") & positive).alias("pb"), F.count_if((p == "after") & positive).alias("pa")
    )
    delta = F.try_divide("pa", "a") - F.try_divide("pb", "b")
    status = F.when(F.least("a", "b") < 8, "insufficient").otherwise("full")
    scored = counted.withColumn("confidence", F.round(periods.confidence(F.col("b"), F.col("a"), status, status, delta), 6))
    return scored.select("product_id", "confidence", periods.confidence_label(F.col("confidence")).alias("label"))


_STRONG, _GENERAL, _CHANGED, _PROMOTED, _EVENTS = (
    "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")" for c, terms in (("title", rules.PATCH_TITLES), ("title", rules.UPDATE_TITLES), ("low", rules.CHANGE_TERMS), ("title", rules.PROMOTION_TERMS), ("title", rules.EVENT_TERMS))
)
_CHANGES = " + ".join(f"contains(low, '{t}')::INT" for t in rules.CHANGE_TERMS)


@query(rf"""WITH n AS (SELECT doc_id, product_id, lower(text) AS low, regexp_extract(text, '^([^\n]*)', 1) AS line, lower(regexp_extract(text, '^([^\n]*)', 1)) AS title, published_at, max(published_at) OVER (PARTITION BY product_id) AS latest FROM documents
    WHERE record_type = 'news' AND text IS NOT NULL AND product_id IS NOT NULL),
  s AS (SELECT *, greatest(0, least(100, CASE WHEN {_STRONG} THEN 45 WHEN {_GENERAL} THEN 25 ELSE 0 END + CASE WHEN {_CHANGES} >= 2 THEN 20 ELSE 0 END + 15 + CASE WHEN regexp_matches(line, '(?i)\b(?:v|version\s*)?\d+\.\d+(?:[a-z])?\b') THEN 10 ELSE 0 END
    + CASE WHEN published_at = latest THEN 10 ELSE 0 END - CASE WHEN {_PROMOTED} THEN 40 ELSE 0 END - CASE WHEN {_EVENTS} THEN 30 ELSE 0 END)) AS score FROM n)
  SELECT product_id, doc_id, score, score >= {rules.PATCH_ACCEPTED} AS accepted FROM s QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY score DESC, published_at NULLS FIRST, line, doc_id) = 1""")
def win_9_best_patch(spark, sf_dir):
    """The news item of each product that most looks like patch notes by its first line, its words and its time, the older of equals."""
    rows = table(spark, sf_dir, "documents").where((F.col("record_type") == "news") & F.col("text").isNotNull() & F.col("product_id").isNotNull())
    latest = rows.groupBy("product_id").agg(F.max("published_at").alias("latest"))
    line = F.regexp_extract("text", r"^([^\n]*)", 1)
    scored = rows.join(latest, "product_id").select("product_id", "doc_id", "published_at", line.alias("line"), rules.patch_score(line, F.col("text"), F.col("published_at") == F.col("latest")).alias("score"))
    best = ranking.top_per_key(scored, ["product_id"], [F.col("score").desc(), F.col("published_at").asc_nulls_first(), F.col("line"), F.col("doc_id")], 1)
    return best.select("product_id", "doc_id", "score", (F.col("score") >= rules.PATCH_ACCEPTED).alias("accepted"))


# Rankings and sets


@query(f"""WITH {TOPICS_SQL}, c AS (SELECT product_id, topic, count(*) FILTER ({_PERIOD} = 'after') - count(*) FILTER ({_PERIOD} = 'before') AS change FROM top WHERE {_PERIOD} IS NOT NULL GROUP BY 1, 2)
  SELECT product_id, topic, change, row_number() OVER (PARTITION BY product_id ORDER BY abs(change) DESC, topic) AS rank FROM c WHERE change <> 0""")
def srt_2_by_change(spark, sf_dir):
    """Topics of each product by the size of their change."""
    rows = _topics(spark, sf_dir, True).withColumn("period", _period()).where(F.col("period").isNotNull())
    changed = periods.compared(rows, ["product_id", "topic"]).where("change <> 0").select("product_id", "topic", "change")
    return ranking.ranked(changed, ["product_id"], [F.abs("change").desc(), F.col("topic")])


@query("""WITH w AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, (CASE WHEN contains(t, 'menu') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'price') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'kitchen') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'booking') THEN 1 ELSE 0 END) AS hits FROM w)
  SELECT doc_id, hits FROM s WHERE hits > 0""")
def srt_7_priority_pages(spark, sf_dir):
    """Documents by how many of the sought terms they hold, those with none left out."""
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return rows.select("doc_id", rules.hits(F.lower("text"), ("menu", "price", "kitchen", "booking")).alias("hits")).where("hits > 0")


@query("""SELECT lead_id, array_to_string(list_sort(list_distinct(list_concat(services, industriesServed))), '|') AS tags, len(list_distinct(list_concat(services, industriesServed))) AS n FROM quickbooks_firms""")
def set_2_distinct_members(spark, sf_dir):
    """The distinct services and industries of each firm together."""
    both = F.array_distinct(F.concat("services", "industriesServed"))
    return table(spark, sf_dir, "quickbooks_firms").select("lead_id", F.array_join(F.array_sort(both), "|").alias("tags"), F.size(both).cast("long").alias("n"))


@query("""SELECT restaurantId, sectionOriginal AS section, max(price.amount) AS highest, max(length(nameOriginal)) AS longest, count(DISTINCT sourceUrl) AS pages FROM menu_items WHERE sectionOriginal IS NOT NULL GROUP BY 1, 2""")
def set_14_candidates_merged(spark, sf_dir):
    """Sections of a restaurant with their highest amount, longest name and number of pages."""
    rows = table(spark, sf_dir, "menu_items").where(F.col("sectionOriginal").isNotNull())
    return rows.groupBy("restaurantId", F.col("sectionOriginal").alias("section")).agg(
        F.max("price.amount").alias("highest"), F.max(F.length("nameOriginal")).alias("longest"), F.countDistinct("sourceUrl").alias("pages")
    )


# Identity


@query("""WITH firms AS (SELECT lower(domain) AS domain, lower(trim(firmName)) AS name FROM xero_firms UNION ALL SELECT lower(domain), lower(trim(firmName)) FROM quickbooks_firms),
  hosts AS (SELECT domain FROM firms WHERE domain IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) > 20),
  x AS (SELECT lead_id, lower(trim(firmName)) AS name, CASE WHEN lower(domain) NOT IN (SELECT domain FROM hosts) THEN lower(domain) END AS domain FROM xero_firms),
  q AS (SELECT lead_id, lower(trim(firmName)) AS name, CASE WHEN lower(domain) NOT IN (SELECT domain FROM hosts) THEN lower(domain) END AS domain FROM quickbooks_firms),
  m AS (SELECT x.lead_id AS a, q.lead_id AS b FROM x JOIN q ON x.name = q.name UNION SELECT x.lead_id, q.lead_id FROM x JOIN q ON x.domain = q.domain)
  SELECT a, b, CASE WHEN x.name = q.name AND x.domain = q.domain THEN 98 WHEN x.domain = q.domain THEN 95 ELSE 65 END AS confidence FROM m JOIN x ON x.lead_id = a JOIN q ON q.lead_id = b""")
def er_6_exact_matches(spark, sf_dir):
    """Firms of both directories with the same name or own domain, with a confidence by what agrees; a domain of more than 20 names is a host."""
    rows = [table(spark, sf_dir, t).select("lead_id", F.lower(F.trim("firmName")).alias("name"), F.lower("domain").alias("domain")) for t in ("xero_firms", "quickbooks_firms")]
    hosts = rows[0].unionByName(rows[1]).where(F.col("domain").isNotNull()).groupBy("domain").agg(F.count_distinct("name").alias("n")).where("n > 20").select("domain", F.lit(True).alias("host"))
    x, q = (r.join(hosts, "domain", "left").select(F.col("lead_id").alias(s), F.col("name").alias(f"name_{s}"), F.when(F.col("host").isNull(), F.col("domain")).alias(f"domain_{s}")) for s, r in zip("ab", rows))
    by_name = x.join(q, F.col("name_a") == F.col("name_b"))
    by_domain = x.join(q, F.col("domain_a") == F.col("domain_b"))
    both = by_name.unionByName(by_domain).dropDuplicates(["a", "b"])
    same_name, same_domain = F.col("name_a") == F.col("name_b"), F.col("domain_a") == F.col("domain_b")
    return both.select("a", "b", F.when(same_name & same_domain, 98).when(same_domain, 95).otherwise(65).alias("confidence"))


@query()
def er_2_slug_ids(spark, sf_dir):
    """Ids of all dishes: the Latin letters and digits of their names, else a hash of the name; a null name has none."""
    name = F.col("nameOriginal")
    slugged = text.slug(text.without_accents(F.translate(name, "đĐ×", "dDx")))
    readable = F.when(slugged != "", slugged).otherwise(F.substring(F.sha2(name, 256), 1, 12))
    return table(spark, sf_dir, "menu_items").select("item_id", F.when(name.isNotNull(), F.concat(F.lit("dish-"), readable)).alias("dish_id"))


@query("""WITH t AS (SELECT item_id, restaurantId, list_distinct(list_filter(regexp_split_to_array(lower(nameOriginal), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS w FROM menu_items WHERE nameOriginal IS NOT NULL)
  SELECT item_id, len(w) AS words FROM t WHERE len(w) > 0""")
def er_4_tokens(spark, sf_dir):
    """How many words of more than two letters each dish has."""
    rows = table(spark, sf_dir, "menu_items").where(F.col("nameOriginal").isNotNull())
    return rows.select("item_id", F.size(clustering.tokens(F.col("nameOriginal"))).cast("long").alias("words")).where("words > 0")


# Scalars


@query("""SELECT row_id, CASE WHEN score IS NULL OR isnan(score) THEN 0 ELSE least(1.0, greatest(0.0, score)) END AS clamped FROM (SELECT row_id, weighted_vote_score * 2 - 0.5 AS score FROM game_reviews)""")
def sc_26_clamped(spark, sf_dir):
    """Stretched scores kept between 0 and 1."""
    return table(spark, sf_dir, "game_reviews").select("row_id", numbers.clamped(F.col("weighted_vote_score") * 2 - 0.5, 0.0, 1.0).alias("clamped"))


@query("""SELECT row_id, CASE WHEN timestamp_updated > 0 THEN strftime(to_timestamp(timestamp_updated) AT TIME ZONE 'UTC', '%Y-%m-%d') END AS day, CASE WHEN timestamp_updated > 0 THEN strftime(to_timestamp(timestamp_updated) AT TIME ZONE 'UTC', '%B %-d, %Y') END AS words FROM game_reviews""")
def sc_28_dates(spark, sf_dir):
    """Days and written dates of epoch seconds."""
    at = F.when(F.col("timestamp_updated") > 0, F.timestamp_seconds("timestamp_updated"))
    return table(spark, sf_dir, "game_reviews").select("row_id", F.date_format(at, "yyyy-MM-dd").alias("day"), F.date_format(at, "MMMM d, yyyy").alias("words"))


@query(r"""SELECT venue_id, nullif(upper(regexp_extract(upper(location.address), '\b([A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2})\b', 1)), '') AS code FROM venues""")
def sc_25_postcodes(spark, sf_dir):
    """British postcodes inside addresses."""
    code = F.regexp_extract(F.upper("location.address"), r"\b([A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2})\b", 1)
    return table(spark, sf_dir, "venues").select("venue_id", F.when(code != "", code).alias("code"))


@query("""SELECT venue_id, 'Venue ' || venue_id || ' in ' || coalesce(location.city, 'unknown') || ' is rated ' || coalesce(CAST(CAST(round(rating * 20) AS BIGINT) AS VARCHAR), 'not') || ' %' AS sentence FROM venues""")
def sc_8_sentences(spark, sf_dir):
    """A sentence about each venue from a template."""
    rating = F.coalesce(F.round(F.col("rating") * 20).cast("long").cast("string"), F.lit("not"))
    sentence = text.filled("Venue {id} in {town} is rated {rating} %", id=F.col("venue_id"), town=F.coalesce("location.city", F.lit("unknown")), rating=rating)
    return table(spark, sf_dir, "venues").select("venue_id", sentence.alias("sentence"))


# Classification


@query(f"""WITH {REVIEWS_SQL} SELECT review_id, count(*) AS deliveries, count(DISTINCT text) AS texts, count(*) - count(DISTINCT text) - count(*) FILTER (text IS NULL) AS cached FROM rev WHERE review_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def cls_5_cache_hits(spark, sf_dir):
    """How many deliveries of a review an analysis kept by text would not run again."""
    grouped = reviews(spark, sf_dir).where(F.col("review_id").isNotNull()).groupBy("review_id").agg(
        F.count(F.lit(1)).alias("deliveries"), F.countDistinct("text").alias("texts"), F.count_if(F.col("text").isNull()).alias("blank")
    )
    return grouped.where("deliveries > 1").select("review_id", "deliveries", "texts", (F.col("deliveries") - F.col("texts") - F.col("blank")).alias("cached"))


@query("""WITH r AS (SELECT * FROM (VALUES ('playground', 'play'), ('museum', 'museum'), ('park', 'park'), ('cafe', 'caf'), ('farm', 'farm')) t(kind, term)) SELECT venue_id, kind FROM venues JOIN r ON contains(lower(nameOriginal), term)""")
def cls_8_venue_kinds(spark, sf_dir):
    """Kinds of venues by terms in their names."""
    kinds = rules.RuleSet({"playground": ("play",), "museum": ("museum",), "park": ("park",), "cafe": ("caf",), "farm": ("farm",)}, (), (), ())
    return table(spark, sf_dir, "venues").select("venue_id", F.explode(rules.topics_of(F.lower(F.coalesce("nameOriginal", F.lit(""))), kinds)).alias("kind"))


@query("""SELECT lead_id, CASE WHEN len(list_filter(services, lambda s: contains(lower(s), 'audit') OR contains(lower(s), 'tax'))) > 0 THEN 'tax' WHEN len(services) > 0 THEN 'books' ELSE 'unknown' END AS kind FROM quickbooks_firms""")
def cls_16_firm_kind(spark, sf_dir):
    """Kind of a firm by its services."""
    tax = F.exists("services", lambda s: F.lower(s).contains("audit") | F.lower(s).contains("tax"))
    return table(spark, sf_dir, "quickbooks_firms").select("lead_id", F.when(tax, "tax").when(F.size("services") > 0, "books").otherwise("unknown").alias("kind"))


@query(f"WITH {ANALYSED_SQL} SELECT sentiment, positive, count(*) AS n FROM ana GROUP BY 1, 2")
def cls_10_sentiments(spark, sf_dir):
    """Rule sentiments against votes."""
    return analysed(spark, sf_dir).groupBy("sentiment", "positive").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 1 AS pairs, count(*) FILTER (timestamp_updated < timestamp_created) AS reversed, count(*) FILTER (timestamp_created IS NULL OR timestamp_created <= 0) AS timeless, count(*) AS n FROM game_reviews""")
def val_5_time_invariants(spark, sf_dir):
    """Reviews that break the order of their times."""
    rows = table(spark, sf_dir, "game_reviews")
    return rows.agg(
        F.lit(1).alias("pairs"),
        F.count_if(F.col("timestamp_updated") < F.col("timestamp_created")).alias("reversed"),
        F.count_if(F.col("timestamp_created").isNull() | (F.col("timestamp_created") <= 0)).alias("timeless"),
        F.count(F.lit(1)).alias("n"),
    )


