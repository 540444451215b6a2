"""SQL for the queries of this subpackage that SQL can express."""

STAND_INS = (
    "'null','none','nil','n/a','na','nan','unknown','undefined','pending','tbd','tba','todo','test','-','--','.','?','0','x','xxx',"
    "'coming soon','not available','ask staff'"
)

P7_FOUND = rf"""
WITH fields AS (
  SELECT restaurantId, row_id, sourceBusiness.scrapedAt AS t, 'website' AS field_name, contact.website AS v FROM restaurants
  UNION ALL SELECT restaurantId, row_id, sourceBusiness.scrapedAt, 'phone', contact.phone FROM restaurants
  UNION ALL SELECT restaurantId, row_id, sourceBusiness.scrapedAt, 'placeId', sourceBusiness.placeId FROM restaurants
), usable AS (
  SELECT *, regexp_replace(v, '\D', '', 'g') AS digits FROM fields
  WHERE v IS NOT NULL AND lower(trim(v)) NOT IN ({STAND_INS})
), kept AS (
  SELECT * FROM usable WHERE CASE field_name
    WHEN 'website' THEN regexp_matches(lower(trim(v)), '^(https?://)?(www\.)?([^\s/?#:@.]+\.)+[^\s/?#:@.0-9]{{2,}}(:[0-9]+)?([/?#]\S*)?$')
    WHEN 'phone' THEN length(digits) BETWEEN 7 AND 15 AND digits <> repeat(left(digits, 1), length(digits)) AND NOT regexp_matches(v, '\p{{L}}{{6,}}')
    ELSE length(trim(v)) >= 8 AND NOT regexp_matches(trim(v), '\s') AND regexp_matches(v, '[0-9]') AND trim(v) <> repeat(left(trim(v), 1), length(trim(v))) END
), several AS (
  SELECT restaurantId FROM restaurants WHERE restaurantId IS NOT NULL GROUP BY restaurantId HAVING count(*) >= 2
)
SELECT restaurantId, field_name, row_id FROM kept JOIN several USING (restaurantId)
QUALIFY row_number() OVER (PARTITION BY restaurantId, field_name ORDER BY t DESC NULLS LAST, row_id) = 1
"""

ORACLE_SQL = {"p7_found": P7_FOUND}
