"""Preparation of the raw review view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import ordered_digest, text_hash
from ..operators import prepare as P
from ..sources.tables import raw_reviews, reviews
from .registry import query
from .views import PREPARED, RAW, REVIEWS, over

# Rules that leave every exclusion reason with rows to report.
RULES = P.Rules(platforms=["app_store", "google_play", "x"], language_filter=["en", "fr", "es"],
                relevance_filter=["human_relevant", "unreviewed"])
REASON = """
reasons AS (
  SELECT *, CASE WHEN model_text = '' THEN 'blank_text'
    WHEN platform NOT IN ('app_store', 'google_play', 'x') THEN 'platform_filter'
    WHEN language IS NULL OR language NOT IN ('en', 'fr', 'es') THEN 'language_filter'
    WHEN relevance NOT IN ('human_relevant', 'unreviewed') THEN 'relevance_filter' END AS reason FROM raw
)"""


@query("prepare_reviews", over(PREPARED, "SELECT * FROM prepared"))
def prepare_reviews(spark, sf):
    return P.prepared_rows(raw_reviews(spark, sf))


@query("prepare_with_titles", over(RAW, """
SELECT record_id, sha256(CASE WHEN trim(coalesce(title, '')) <> '' THEN trim(title) || chr(10) || model_text ELSE model_text END) AS text_hash
FROM raw WHERE model_text <> ''"""))
def prepare_with_titles(spark, sf):
    return P.prepared_rows(raw_reviews(spark, sf), P.Rules(combine_title_body=True)).select("record_id", "text_hash")


@query("prepare_exclusions", over(RAW, f", {REASON.strip()} SELECT record_id, reason FROM reasons WHERE reason IS NOT NULL"))
def prepare_exclusions(spark, sf):
    return P.excluded_rows(raw_reviews(spark, sf), RULES)


@query("prepare_report", over(RAW, f""", {REASON.strip()},
p AS (SELECT platform, count(*) AS input_count, count(*) FILTER (WHERE reason IS NULL) AS row_count,
  count(*) FILTER (WHERE reason IS NOT NULL) AS excluded_count, count(*) FILTER (WHERE date_precision = 'second' AND length(record_date) = 10) AS date_normalizations
  FROM reasons GROUP BY platform)
SELECT * FROM p UNION ALL SELECT '(all)', CAST(sum(input_count) AS BIGINT), CAST(sum(row_count) AS BIGINT), CAST(sum(excluded_count) AS BIGINT), CAST(sum(date_normalizations) AS BIGINT) FROM p"""))
def prepare_report(spark, sf):
    return P.report(raw_reviews(spark, sf), RULES)


@query("date_recovery", over(RAW, """
SELECT record_id, CASE WHEN date_precision = 'second' THEN updated_at ELSE record_date END AS record_date,
  date_precision = 'second' AND length(record_date) = 10 AS date_recovered FROM raw"""))
def date_recovery(spark, sf):
    return P.recover_dates(raw_reviews(spark, sf)).select("record_id", "record_date", "date_recovered")


@query("prepare_violations", over(RAW, """
SELECT record_id, 'rating_out_of_range' AS rule FROM raw WHERE rating NOT BETWEEN 1 AND 5
UNION ALL SELECT record_id, 'date_missing_date' FROM raw WHERE record_date IS NULL AND date_precision <> 'unknown'
UNION ALL SELECT record_id, 'null_language' FROM raw WHERE relevance IS NULL
UNION ALL SELECT record_id, 'duplicate_record_id' FROM raw GROUP BY record_id HAVING count(*) > 1"""))
def prepare_violations(spark, sf):
    return P.violations(raw_reviews(spark, sf))


@query("text_hash", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def text_hash_query(spark, sf):
    return reviews(spark, sf).select(F.col("source_row").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"))


@query("strip_unicode", over(REVIEWS, "SELECT record_id, length(model_text) AS stripped_length, sha256(model_text) AS stripped_hash FROM reviews"))
def strip_unicode(spark, sf):
    stripped = X.strip(F.col("text"))
    return reviews(spark, sf).select(
        "record_id", F.length(stripped).cast("bigint").alias("stripped_length"), text_hash(stripped).alias("stripped_hash")
    )


@query("ordered_digest", over(REVIEWS, """,
cells AS (SELECT source_row AS pos, sha256(concat_ws('|', CAST(source_row AS VARCHAR),
  CAST(octet_length(encode(record_id)) AS VARCHAR) || ':' || record_id, '64:' || sha256(model_text))) AS digest FROM reviews),
l1 AS (SELECT CAST(floor(pos / 4096) AS BIGINT) AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM cells GROUP BY floor(pos / 4096)),
l2 AS (SELECT CAST(floor(pos / 4096) AS BIGINT) AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM l1 GROUP BY floor(pos / 4096)),
l3 AS (SELECT CAST(floor(pos / 4096) AS BIGINT) AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM l2 GROUP BY floor(pos / 4096))
SELECT (SELECT count(*) FROM reviews) AS rows, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM l3"""))
def ordered_digest_query(spark, sf):
    return ordered_digest(reviews(spark, sf), "source_row", ["record_id", "text_hash"])
