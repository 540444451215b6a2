"""Listings, dishes and firms: scalar expressions, duplicates by key, merges and snapshot changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernweave.functions import numbers, text, web
from fernweave.operators import changes, joins, merging, quality, ranking
from fernweave.plans.catalog import Catalog
from fernweave.session import table

query = Catalog()
SNAPSHOT_DAY = "2025-06-01"

_CLEAN = "nullif(trim(regexp_replace({0}, '[ \\t\\r\\n\\x0B\\f]+', ' ', 'g')), '')"
_HOST = (
    "(SELECT CASE WHEN contains(h, '.') THEN h END FROM (SELECT regexp_replace(regexp_extract(lower(trim({0})), "
    "'^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)', 1), '^(www\\d*|m)\\.', '') AS h))"
)


@query(f"SELECT item_id, {_CLEAN.format('nameOriginal')} AS name, left({_CLEAN.format('descriptionOriginal')}, 12) AS snippet FROM menu_items")
def sc_1_clean_text(spark, sf_dir):
    """Dish names with single blanks and the first characters of descriptions."""
    return table(spark, sf_dir, "menu_items").select("item_id", text.clean_text(F.col("nameOriginal")).alias("name"), text.snippet(F.col("descriptionOriginal"), 12).alias("snippet"))


@query(r"""SELECT venue_id, strip_accents(lower(location.city)) AS folded, trim(regexp_replace(strip_accents(lower(translate(nameOriginal, 'đĐ×', 'dDx'))), '[^a-z0-9]+', ' ', 'g')) AS title FROM venues""")
def sc_2_folded_names(spark, sf_dir):
    """Towns without accents and venue names as plain titles."""
    return table(spark, sf_dir, "venues").select("venue_id", text.without_accents(F.lower("location.city")).alias("folded"), text.normal_title(F.col("nameOriginal")).alias("title"))


@query(r"SELECT lead_id, substr(regexp_replace(regexp_replace(lower(firmName), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 80) AS slug FROM xero_firms")
def sc_7_slugs(spark, sf_dir):
    """Slugs of firm names."""
    return table(spark, sf_dir, "xero_firms").select("lead_id", text.slug(F.col("firmName")).alias("slug"))


@query("SELECT venue_id, CASE WHEN regexp_matches(lower(nameOriginal), '[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]') THEN 'vi' ELSE 'en' END AS lang FROM venues")
def sc_5_language_hint(spark, sf_dir):
    """Language guess of venue names by their letters."""
    return table(spark, sf_dir, "venues").select("venue_id", text.looks_vietnamese(F.col("nameOriginal")).alias("lang"))


@query(f"SELECT row_id, {_HOST.format('contact.website')} AS host FROM restaurants")
def sc_9_hosts(spark, sf_dir):
    """Hosts of web addresses."""
    return table(spark, sf_dir, "restaurants").select("row_id", web.host_of(F.col("contact.website")).alias("host"))


@query(r"""SELECT row_id, CASE WHEN regexp_matches(lower(sourceBusiness.sourceUrl), '^\s*https?://[^/\s]+') THEN regexp_replace(regexp_replace(trim(sourceBusiness.sourceUrl), '[?#].*$', ''), '/+$', '') END AS url,
  nullif(regexp_extract(sourceBusiness.sourceUrl, '[?&]v=([^&#]*)', 1), '') AS version FROM restaurants""")
def sc_10_urls(spark, sf_dir):
    """Addresses without query and the version in the query."""
    url = F.col("sourceBusiness.sourceUrl")
    return table(spark, sf_dir, "restaurants").select("row_id", web.normal_url(url).alias("url"), web.query_value(url, "v").alias("version"))


@query(r"""WITH a AS (SELECT row_id, regexp_replace(regexp_replace(trim(contact.website), '#.*$', ''), '(?i)^https?://(www\.)?', '') AS x FROM restaurants WHERE regexp_matches(contact.website, '(?i)^https?://[^/\s.]+\.')),
  b AS (SELECT row_id, lower(regexp_extract(x, '^([^/?]*)', 1)) AS host, regexp_replace(regexp_replace(regexp_replace(regexp_extract(x, '^[^/?]*(.*)$', 1), '(?i)([?&])(?:utm_[a-z]+|fbclid|gclid|ref)=[^&]*', '\1', 'g'),
    '([?&])&+', '\1', 'g'), '[?&]+$', '') AS rest FROM a)
  SELECT restaurants.row_id, 'https://' || host || regexp_replace(rest, '/+(\?|$)', '\1') AS canonical FROM restaurants LEFT JOIN b USING (row_id)""")
def sc_11_canonical_urls(spark, sf_dir):
    """One spelling of each web address."""
    website = F.col("contact.website")
    return table(spark, sf_dir, "restaurants").select("row_id", F.when(website.rlike(r"(?i)^https?://[^/\s.]+\."), web.canonical_url(website)).alias("canonical"))


@query(r"""WITH a AS (SELECT venue_id, regexp_replace(contact.phone, '[^0-9+]', '', 'g') AS x FROM venues), b AS (SELECT venue_id, regexp_extract(x, '^(\+?)', 1) || replace(x, '+', '') AS x FROM a)
  SELECT venue_id, CASE WHEN length(replace(x, '+', '')) >= 7 THEN x END AS phone FROM b""")
def sc_12_phones(spark, sf_dir):
    """Plus and digits of telephone numbers."""
    return table(spark, sf_dir, "venues").select("venue_id", web.phone_digits(F.col("contact.phone")).alias("phone"))


@query(r"""WITH e AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '([a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+)', 1))) AS email FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, email, CASE WHEN regexp_matches(email, '^(info|hello|contact|office|desk|mail)[^@]*@') THEN 'general' WHEN regexp_matches(email, '^(sales|quote|orders?)[^@]*@') THEN 'sales'
    WHEN regexp_matches(email, '^(support|help|service)[^@]*@') THEN 'support' WHEN regexp_matches(email, '^(jobs?|careers?|hr)[^@]*@') THEN 'hiring'
    WHEN regexp_matches(email, '^(press|media|marketing)[^@]*@') THEN 'press' ELSE 'personal' END AS kind FROM e""")
def sc_13_emails(spark, sf_dir):
    """Mail addresses in documents and what they are for."""
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return rows.select("doc_id", F.explode(web.emails_in(F.col("text"))).alias("email")).withColumn("kind", web.email_kind(F.col("email")))


_BODY = "'978' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')"


@query(f"""WITH n AS (SELECT p_partkey, {_BODY} || CAST(p_size % 10 AS VARCHAR) AS isbn FROM part), d AS (SELECT *, list_sum(list_transform(range(13), lambda k: CAST(substr(isbn, CAST(k AS INTEGER) + 1, 1) AS INTEGER) * (CASE WHEN k % 2 = 0 THEN 1 ELSE 3 END))) AS total,
    list_sum(list_transform(range(9), lambda k: CAST(substr(isbn, CAST(k AS INTEGER) + 4, 1) AS INTEGER) * (10 - k))) AS ten FROM n)
  SELECT p_partkey, isbn, total % 10 = 0 AS valid, substr(isbn, 4, 9) || CASE (11 - ten % 11) % 11 WHEN 10 THEN 'X' ELSE CAST((11 - ten % 11) % 11 AS VARCHAR) END AS isbn10 FROM d""")
def sc_17_isbn(spark, sf_dir):
    """Book numbers with a check digit that mostly doesn't fit, their test, and the ten-digit number of the same book."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("978"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), (F.col("p_size") % 10).cast("string")).alias("isbn"))
    return parts.withColumn("valid", numbers.isbn13_valid(F.col("isbn"))).withColumn("isbn10", numbers.isbn10_of(F.substring("isbn", 4, 9)))


@query(f"""WITH n AS (SELECT p_partkey, substr({_BODY}, 4) AS nine FROM part), d AS (SELECT *, list_sum(list_transform(range(9), lambda k: CAST(substr(nine, CAST(k AS INTEGER) + 1, 1) AS INTEGER) * (10 - k))) AS ten FROM n),
    c AS (SELECT p_partkey, nine || CASE WHEN p_partkey % 3 = 0 THEN 'X' ELSE CAST(p_partkey % 10 AS VARCHAR) END AS code, CASE WHEN p_partkey % 3 = 0 THEN 10 ELSE p_partkey % 10 END AS digit, ten FROM d)
  SELECT p_partkey, code, (ten + digit) % 11 = 0 AS valid FROM c""")
def sc_17_isbn10(spark, sf_dir):
    """Ten-digit book numbers with a right or wrong check sign, and their test."""
    nine = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    sign = F.when(F.col("p_partkey") % 3 == 0, "X").otherwise((F.col("p_partkey") % 10).cast("string"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(nine, sign).alias("code"))
    return parts.withColumn("valid", numbers.isbn10_valid(F.col("code")))


@query("""SELECT lead_id, 'lead:' || left(sha256(coalesce(lower(firmName), '') || '|' || coalesce(domain, '') || '|' || coalesce(locations[1].city, '')), 24) AS stable_id FROM quickbooks_firms""")
def er_10_stable_ids(spark, sf_dir):
    """Stable ids of firms from name, domain and town."""
    rows = table(spark, sf_dir, "quickbooks_firms")
    return rows.select("lead_id", numbers.stable_id("lead", F.lower("firmName"), F.col("domain"), F.try_element_at("locations", F.lit(1))["city"]).alias("stable_id"))


@query("""WITH k AS (SELECT row_id, sourceBusiness.canonicalUrl AS key FROM restaurants) SELECT row_id FROM k QUALIFY key IS NULL OR row_number() OVER (PARTITION BY key ORDER BY row_id) = 1""")
def set_3_first_by_key(spark, sf_dir):
    """The first record of each canonical address; records without one all stay."""
    rows = table(spark, sf_dir, "restaurants").select("row_id", F.col("sourceBusiness.canonicalUrl").alias("url"))
    return merging.first_by_key(rows, F.col("url"), "row_id").select("row_id")


@query("""WITH k AS (SELECT row_id, restaurantId AS key, nullif(trim(restaurantName), '') AS name, location.city AS city, contact.phone AS phone, matchedKeywords AS words FROM restaurants),
  m AS (SELECT key, string_agg(DISTINCT w, ',' ORDER BY w) AS keywords FROM (SELECT key, unnest(words) AS w FROM k) GROUP BY 1)
  SELECT min(row_id) AS row_id, count(*) AS records, first(name ORDER BY row_id) FILTER (name IS NOT NULL) AS name, first(city ORDER BY row_id) FILTER (trim(city) <> '') AS city,
    first(phone ORDER BY row_id) FILTER (trim(phone) <> '') AS phone, any_value(m.keywords) AS keywords FROM k LEFT JOIN m USING (key) GROUP BY key""")
def set_7_merged_records(spark, sf_dir):
    """One record per restaurant: first known fields and the union of keywords."""
    rows = table(spark, sf_dir, "restaurants").select(
        "row_id", "restaurantId", F.trim("restaurantName").alias("name"), F.col("location.city").alias("city"), F.col("contact.phone").alias("phone"), F.col("matchedKeywords").alias("keywords")
    )
    out = merging.merged(rows, F.col("restaurantId"), "row_id", ["name", "city", "phone"], ["keywords"])
    return out.withColumn("keywords", F.array_join("keywords", ","))


@query("""WITH k AS (SELECT lead_id, CASE WHEN domain IS NOT NULL AND domain <> '' THEN 'd:' || lower(domain) WHEN len(phoneNumbers) > 0 THEN 'p:' || regexp_replace(phoneNumbers[1], '[^0-9]', '', 'g')
    ELSE 'n:' || lower(firmName) || '|' || coalesce(lower(locations[1].city), '') END AS key FROM quickbooks_firms)
  SELECT key, min(lead_id) AS lead_id, count(*) AS records FROM k GROUP BY 1""")
def set_8_priority_key(spark, sf_dir):
    """Firms grouped by domain, else telephone, else name and town."""
    phone = F.regexp_replace(F.try_element_at("phoneNumbers", F.lit(1)), "[^0-9]", "")
    city = F.coalesce(F.lower(F.try_element_at("locations", F.lit(1))["city"]), F.lit(""))
    key = (
        F.when(F.col("domain").isNotNull() & (F.col("domain") != ""), F.concat(F.lit("d:"), F.lower("domain")))
        .when(F.size("phoneNumbers") > 0, F.concat(F.lit("p:"), phone))
        .otherwise(F.concat(F.lit("n:"), F.lower("firmName"), F.lit("|"), city))
    )
    return table(spark, sf_dir, "quickbooks_firms").groupBy(key.alias("key")).agg(F.min("lead_id").alias("lead_id"), F.count(F.lit(1)).alias("records"))


@query("""SELECT restaurantId, nameOriginal AS name, min(item_id) AS item_id, count(*) AS copies, max(price.amount) AS amount FROM menu_items WHERE nameOriginal IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def set_9_repeated_dishes(spark, sf_dir):
    """Dishes of a restaurant that were read more than once."""
    rows = table(spark, sf_dir, "menu_items").where(F.col("nameOriginal").isNotNull()).groupBy("restaurantId", F.col("nameOriginal").alias("name"))
    return rows.agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("copies"), F.max("price.amount").alias("amount")).where("copies > 1")


@query("""SELECT restaurantId, max(item_id) AS last_item, min(item_id) AS first_item, last(sectionOriginal ORDER BY item_id) AS last_section, first(nameOriginal ORDER BY item_id) AS first_name FROM menu_items GROUP BY 1""")
def set_12_last_over_first(spark, sf_dir):
    """Later fields overwrite, the earliest name stays."""
    seq = F.col("item_id")
    return table(spark, sf_dir, "menu_items").groupBy("restaurantId").agg(
        F.max(seq).alias("last_item"), F.min(seq).alias("first_item"), merging.last_value(F.col("sectionOriginal"), seq).alias("last_section"), F.min_by("nameOriginal", seq).alias("first_name")
    )


@query("""WITH p AS (SELECT restaurantId, list_sort(list_distinct(list(sectionOriginal) FILTER (item_id % 2 = 0 AND sectionOriginal IS NOT NULL))) AS a, list_sort(list_distinct(list(sectionOriginal) FILTER (item_id % 2 = 1 AND sectionOriginal IS NOT NULL))) AS b FROM menu_items GROUP BY 1)
  SELECT restaurantId, array_to_string(list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))), ',') AS added, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))), ',') AS removed FROM p""")
def set_16_differences(spark, sf_dir):
    """Sections that only one half of a restaurant's dishes has."""
    even = F.col("item_id") % 2 == 0
    halves = table(spark, sf_dir, "menu_items").groupBy("restaurantId").agg(
        F.collect_set(F.when(even, F.col("sectionOriginal"))).alias("a"), F.collect_set(F.when(~even, F.col("sectionOriginal"))).alias("b")
    )
    return halves.select("restaurantId", F.array_join(F.array_sort(F.array_except("b", "a")), ",").alias("added"), F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("removed"))


@query("""SELECT restaurantId, count(*) FILTER (price.amount IS NOT NULL) AS priced, min(price.amount) AS lowest, max(price.amount) AS highest, first(price.currency ORDER BY item_id) FILTER (price.currency IS NOT NULL) AS currency FROM menu_items GROUP BY 1""")
def agg_16_summary(spark, sf_dir):
    """Range of amounts and first currency of each restaurant."""
    return table(spark, sf_dir, "menu_items").groupBy("restaurantId").agg(
        F.count("price.amount").alias("priced"), F.min("price.amount").alias("lowest"), F.max("price.amount").alias("highest"), merging.first_value(F.col("price.currency"), F.col("item_id")).alias("currency")
    )


@query("""SELECT location.countryCode AS country, count(*) AS venues, count(contact.phone) AS with_phone, count(contact.website) AS with_website, count(contact.email) AS with_email FROM venues GROUP BY 1""")
def agg_19_contact_rates(spark, sf_dir):
    """How many venues of a country have which contact."""
    return table(spark, sf_dir, "venues").groupBy(F.col("location.countryCode").alias("country")).agg(
        F.count(F.lit(1)).alias("venues"), F.count("contact.phone").alias("with_phone"), F.count("contact.website").alias("with_website"), F.count("contact.email").alias("with_email")
    )


@query("""SELECT record_type, source, count(*) AS n, count(text) AS with_text FROM documents GROUP BY 1, 2""")
def agg_20_record_types(spark, sf_dir):
    """Documents by type and source."""
    return table(spark, sf_dir, "documents").groupBy("record_type", "source").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("with_text"))


@query("""WITH d AS (SELECT lower(regexp_extract(website, '^https?://(?:www\\.)?([^/]+)', 1)) AS host, lead_id, services, descriptionOriginal AS text FROM xero_firms WHERE website IS NOT NULL)
  SELECT host, count(*) AS pages, first(text ORDER BY lead_id) FILTER (trim(text) <> '') AS description, (SELECT string_agg(DISTINCT s, ',' ORDER BY s) FROM (SELECT unnest(services) AS s FROM d e WHERE e.host = d.host)) AS services FROM d GROUP BY host""")
def agg_22_pages_per_host(spark, sf_dir):
    """What the pages of a host say together: first description, union of services."""
    host = F.lower(F.regexp_extract("website", r"^https?://(?:www\.)?([^/]+)", 1))
    rows = table(spark, sf_dir, "xero_firms").where(F.col("website").isNotNull()).select(host.alias("host"), "lead_id", "services", F.col("descriptionOriginal").alias("description"))
    out = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), merging.first_value(F.col("description"), F.col("lead_id")).alias("description"))
    return out.join(merging.members(rows, ["host"], "services"), "host", "left").withColumn("services", F.array_join("services", ","))


@query("""WITH read AS MATERIALIZED (SELECT restaurantId, row_id, rating, reviewCount, contact, coalesce(epoch_us(sourceBusiness.scrapedAt), 0) < 1748736000000000 AS early FROM restaurants), o AS (SELECT restaurantId, rating, reviewCount, contact.phone AS phone FROM read WHERE early QUALIFY row_number() OVER (PARTITION BY restaurantId ORDER BY row_id) = 1),
  n AS (SELECT restaurantId, rating, reviewCount, contact.phone AS phone FROM read WHERE NOT early QUALIFY row_number() OVER (PARTITION BY restaurantId ORDER BY row_id DESC) = 1),
  j AS (SELECT coalesce(o.restaurantId, n.restaurantId) AS restaurantId, o.restaurantId IS NULL AS isnew, n.restaurantId IS NULL AS gone, o.rating AS r1, n.rating AS r2, o.reviewCount AS c1, n.reviewCount AS c2, o.phone AS p1, n.phone AS p2 FROM o FULL JOIN n ON o.restaurantId = n.restaurantId)
  SELECT restaurantId, 'added' AS change FROM j WHERE isnew UNION ALL SELECT restaurantId, 'removed' FROM j WHERE gone
  UNION ALL SELECT restaurantId, CASE WHEN r2 > r1 THEN 'ratingIncreased' WHEN r2 < r1 THEN 'ratingDecreased' ELSE 'ratingChanged' END FROM j WHERE NOT isnew AND NOT gone AND r1 IS DISTINCT FROM r2
  UNION ALL SELECT restaurantId, CASE WHEN c2 > c1 THEN 'reviewsIncreased' WHEN c2 < c1 THEN 'reviewsDecreased' ELSE 'reviewsChanged' END FROM j WHERE NOT isnew AND NOT gone AND c1 IS DISTINCT FROM c2
  UNION ALL SELECT restaurantId, 'contactChanged' FROM j WHERE NOT isnew AND NOT gone AND p1 IS DISTINCT FROM p2""")
def er_12_snapshot_changes(spark, sf_dir):
    """What changed between the snapshots of records read before and after a day; records without time count as read before."""
    rows = table(spark, sf_dir, "restaurants").select("restaurantId", "row_id", "rating", "reviewCount", F.col("contact.phone").alias("phone"), F.col("sourceBusiness.scrapedAt").alias("at"))
    early = F.coalesce(F.col("at") < F.lit(SNAPSHOT_DAY).cast("timestamp"), F.lit(True))
    old = joins.one_per_key(rows.where(early).drop("at"), ["restaurantId"], "row_id")
    new = joins.one_per_key(rows.where(~early).drop("at"), ["restaurantId"], "row_id", last=True)
    found = changes.snapshot_changes(old, new, "restaurantId", {"rating": ["rating"], "reviews": ["reviewCount"], "contact": ["phone"]})
    return found.select("restaurantId", "change")


@query("""WITH t AS (SELECT venue_id, unnest(venueTypes) AS kind, rating FROM venues) SELECT kind, venue_id, rating FROM t WHERE rating IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind ORDER BY rating DESC, venue_id) <= 10""")
def srt_9_best_venues(spark, sf_dir):
    """The ten best rated venues of each type."""
    rows = table(spark, sf_dir, "venues").where(F.col("rating").isNotNull()).select("venue_id", F.explode("venueTypes").alias("kind"), "rating")
    return ranking.top_per_key(rows, ["kind"], [F.col("rating").desc(), F.col("venue_id")], 10).drop("rank")


@query("""SELECT venue_id, array_to_string(list_filter([CASE WHEN NOT coalesce(location.address <> '', false) THEN 'address' END, CASE WHEN NOT coalesce(location.latitude BETWEEN -90 AND 90, false) THEN 'latitude' END,
  CASE WHEN NOT coalesce(rating BETWEEN 0 AND 5, false) THEN 'rating' END], lambda x: x IS NOT NULL), ',') AS violations FROM venues
  WHERE NOT (coalesce(location.address <> '', false) AND coalesce(location.latitude BETWEEN -90 AND 90, false) AND coalesce(rating BETWEEN 0 AND 5, false))""")
def snk_4_invalid_rows(spark, sf_dir):
    """Venues that would not be written, with the rules they break."""
    rules = {"address": F.col("location.address") != "", "latitude": F.col("location.latitude").between(-90, 90), "rating": F.col("rating").between(0, 5)}
    _, invalid = quality.split_by_validity(table(spark, sf_dir, "venues"), rules)
    return invalid.select("venue_id", F.array_join("violations", ",").alias("violations"))


@query("""WITH i AS (SELECT restaurantId, item_id, unnest(extractionMethods) AS method FROM menu_items) SELECT restaurantId, method, count(DISTINCT item_id) AS items FROM i GROUP BY 1, 2 HAVING count(DISTINCT item_id) >= 2""")
def agg_15_shared_tags(spark, sf_dir):
    """Tags that two dishes or more of a restaurant carry."""
    rows = table(spark, sf_dir, "menu_items").select("restaurantId", "item_id", F.explode("extractionMethods").alias("method")).distinct()
    return rows.groupBy("restaurantId", "method").agg(F.count("item_id").alias("items")).where("items >= 2")


@query("""SELECT a.city, b.kind FROM (SELECT DISTINCT location.city AS city FROM venues WHERE location.city IS NOT NULL) a CROSS JOIN (SELECT DISTINCT unnest(venueTypes) AS kind FROM venues) b""")
def jn_16_parameter_grid(spark, sf_dir):
    """Every town with every venue type, as search jobs; both sides are small lists of distinct names."""
    venues = table(spark, sf_dir, "venues")
    towns = venues.select(F.col("location.city").alias("city")).where("city is not null").distinct()
    kinds = venues.select(F.explode("venueTypes").alias("kind")).distinct().agg(F.collect_set("kind").alias("kinds"))
    return towns.join(kinds, F.lit(True)).select("city", F.explode("kinds").alias("kind"))


@query("""SELECT restaurants.row_id, count(menu_items.item_id) AS items FROM restaurants LEFT JOIN menu_items ON menu_items.restaurantId = restaurants.restaurantId AND menu_items.price.amount IS NOT NULL GROUP BY 1""")
def jn_14_items_per_record(spark, sf_dir):
    """Each record with the number of priced dishes of its restaurant."""
    counted = table(spark, sf_dir, "menu_items").where(F.col("price.amount").isNotNull()).groupBy("restaurantId").agg(F.count(F.lit(1)).alias("items"))
    return table(spark, sf_dir, "restaurants").select("row_id", "restaurantId").join(counted, "restaurantId", "left").select("row_id", F.coalesce("items", F.lit(0)).alias("items"))


