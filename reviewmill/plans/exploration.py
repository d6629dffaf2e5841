"""Exploratory statistics over the review view."""

from __future__ import annotations

from ..functions import text as X
from ..operators import explore as E
from ..operators import prepare as P
from ..sources.tables import raw_reviews, reviews
from .registry import query
from .views import PREPARED, REVIEWS, over

STOP = ", ".join(f"'{w}'" for w in X.EXPLORATION_STOP_WORDS)
TOKENS = REVIEWS + rf""",
tokens AS (
  SELECT source_row, rating, text,
    regexp_extract_all(regexp_replace(replace(lower(text), 'ß', 'ss'), 'https?://\S+|www\.\S+', ' ', 'g'), '[\p{{L}}\p{{Nl}}\p{{No}}]+') AS words
  FROM reviews
), kept AS (
  SELECT source_row, rating, words, list_filter(words, lambda w: w NOT IN ({STOP})) AS kept FROM tokens
)"""


def prepared(spark, sf):
    return P.prepared_rows(raw_reviews(spark, sf))


PROFILE_COLUMNS = ["record_id", "platform", "app_id", "country", "text", "title", "rating", "language", "preferred_provider", "model_text", "text_hash"]
_profile = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, "
    f"round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct, count(DISTINCT {c}) AS distinct_values FROM r"
    for c in PROFILE_COLUMNS
)


@query("column_profile", over(REVIEWS, f""",
r AS (SELECT *, sha256(model_text) AS text_hash FROM reviews)
SELECT p.column_name, CASE WHEN p.column_name = 'rating' THEN 'int' ELSE 'string' END AS data_type, missing,
  CAST(missing_pct AS DOUBLE) AS missing_pct, distinct_values FROM ({_profile}) p"""))
def column_profile(spark, sf):
    return E.column_profile(reviews(spark, sf).select(*PROFILE_COLUMNS))


@query("quality_controls", over(REVIEWS, """
SELECT count(*) AS rows, count(*) - count(record_id) AS missing_ids,
  count(record_id) - count(DISTINCT record_id) AS repeated_ids,
  count(*) FILTER (WHERE model_text = '') AS blank_texts, count(*) FILTER (WHERE model_text = '') AS blank_prepared_texts,
  count(*) FILTER (WHERE model_text <> '') - count(DISTINCT model_text) FILTER (WHERE model_text <> '') AS repeated_prepared_texts,
  count(*) FILTER (WHERE text <> model_text) AS changed_texts
FROM reviews"""))
def quality_controls(spark, sf):
    return E.quality_controls(reviews(spark, sf))


CATEGORIES = ["platform", "language", "relevance", "preferred_provider", "country", "app_id"]


@query("cardinality", over(REVIEWS, " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM reviews" for c in CATEGORIES)))
def cardinality(spark, sf):
    return E.cardinality(reviews(spark, sf, "relevance"), CATEGORIES)


@query("platform_summary", over(REVIEWS, """
SELECT platform, count(*) AS reviews, count(rating) AS rated, round(avg(rating), 2) AS mean_rating FROM reviews GROUP BY platform"""))
def platform_summary(spark, sf):
    return E.platform_summary(reviews(spark, sf))


@query("language_summary", over(REVIEWS, """
SELECT coalesce(language, 'desconocido') AS language, count(*) AS reviews FROM reviews GROUP BY 1"""))
def language_summary(spark, sf):
    return E.language_summary(reviews(spark, sf))


@query("date_basis_counts", over(PREPARED, "SELECT date_basis, count(*) AS reviews FROM prepared GROUP BY 1"))
def date_basis_counts(spark, sf):
    return E.value_counts(prepared(spark, sf), "date_basis")


@query("rating_histogram", over(REVIEWS, """
SELECT CAST(s.star AS INT) AS rating, count(r.rating) AS reviews FROM range(1, 6) s(star)
LEFT JOIN reviews r ON r.rating = s.star GROUP BY 1"""))
def rating_histogram(spark, sf):
    return E.rating_histogram(reviews(spark, sf))


@query("length_histogram", over(REVIEWS, """,
e AS (SELECT min(length(text)) AS lo, max(length(text)) AS hi FROM reviews),
b AS (SELECT CAST(least(floor((length(text) - lo) * 50 / (hi - lo)::DOUBLE), 49) AS INT) AS bin FROM reviews, e)
SELECT CAST(g.bin AS INT) AS bin, round(lo + g.bin * ((hi - lo) / 50.0::DOUBLE), 6) AS bin_start,
  round(lo + (g.bin + 1) * ((hi - lo) / 50.0::DOUBLE), 6) AS bin_end, count(b.bin) AS reviews
FROM range(50) g(bin) LEFT JOIN b ON b.bin = g.bin, e GROUP BY g.bin, lo, hi"""))
def length_histogram(spark, sf):
    return E.length_histogram(reviews(spark, sf))


@query("iqr_outliers", over(REVIEWS, """,
l AS (SELECT CAST(length(text) AS DOUBLE) AS n FROM reviews),
q AS (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3 FROM l)
SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(q1 - 1.5::DOUBLE * (q3 - q1), 6) AS lower_fence,
  round(q3 + 1.5::DOUBLE * (q3 - q1), 6) AS upper_fence,
  count(*) FILTER (WHERE n < q1 - 1.5::DOUBLE * (q3 - q1) OR n > q3 + 1.5::DOUBLE * (q3 - q1)) AS outliers,
  round(100.0::DOUBLE * count(*) FILTER (WHERE n < q1 - 1.5::DOUBLE * (q3 - q1) OR n > q3 + 1.5::DOUBLE * (q3 - q1)) / count(*), 6) AS outlier_pct
FROM l, q GROUP BY q1, q3"""))
def iqr_outliers(spark, sf):
    return E.iqr_outliers(reviews(spark, sf))


@query("length_skew", over(REVIEWS, """
SELECT round(skewness(length(text)), 4) AS length_skew, round(skewness(ln(1.0::DOUBLE + length(text))), 4) AS log_length_skew FROM reviews"""))
def length_skew(spark, sf):
    return E.length_skew(reviews(spark, sf))


@query("length_by_rating", over(REVIEWS, """,
b AS (
  SELECT 'star ' || rating AS bucket, length(text) AS n FROM reviews WHERE rating IS NOT NULL
  UNION ALL
  SELECT CASE WHEN rating <= 2 THEN 'group 1-2' WHEN rating = 3 THEN 'group 3' ELSE 'group 4-5' END, length(text)
  FROM reviews WHERE rating IS NOT NULL)
SELECT bucket, count(*) AS reviews, round(sum(n)::DOUBLE / count(*), 6) AS mean_length,
  round(median(n)::DOUBLE, 6) AS median_length, max(n) AS max_length FROM b GROUP BY bucket"""))
def length_by_rating(spark, sf):
    return E.length_by_rating(reviews(spark, sf))


# The engine behind the SQL check has no back-references: repeated letters are
# counted there by comparing neighbouring characters.
@query("pattern_rates", over(REVIEWS, r""",
m AS (
  SELECT regexp_matches(text, '[!?¡¿]{2,}') AS repeated_marks,
    regexp_matches(text, '(^|[^\p{L}\p{M}\p{N}_])[A-ZÁÉÍÓÚÜÑ]{2,}($|[^\p{L}\p{M}\p{N}_])') AS upper_case,
    regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}_])(?:no|nunca|jamás|tampoco|sin|ni)($|[^\p{L}\p{M}\p{N}_])') AS negations,
    regexp_matches(text, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]') AS emoji,
    regexp_matches(text, 'https?://\S+|www\.\S+') AS links,
    regexp_matches(text, '\$\s*\d[\d,]*(?:\.\d{1,2})?') AS amounts
  FROM reviews),
u AS (UNPIVOT (SELECT count(*) AS n, count(*) FILTER (WHERE repeated_marks) AS repeated_marks, count(*) FILTER (WHERE upper_case) AS upper_case,
    count(*) FILTER (WHERE negations) AS negations, count(*) FILTER (WHERE emoji) AS emoji, count(*) FILTER (WHERE links) AS links,
    count(*) FILTER (WHERE amounts) AS amounts FROM m)
  ON repeated_marks, upper_case, negations, emoji, links, amounts INTO NAME pattern VALUE reviews)
SELECT pattern, reviews, round(100.0::DOUBLE * reviews / n, 6) AS review_pct FROM u"""))
def pattern_rates(spark, sf):
    return E.pattern_rates(reviews(spark, sf), [p for p in E.PATTERNS if p != "repeated_letters"])


@query("repeated_letters", over(REVIEWS, r""",
c AS (SELECT source_row, text, unnest(range(1, length(text) - 1)) AS i FROM reviews),
h AS (SELECT DISTINCT source_row FROM c WHERE text[i] = text[i + 1] AND text[i] = text[i + 2] AND regexp_matches(text[i], '[\p{L}\p{Nl}\p{No}]'))
SELECT 'repeated_letters' AS pattern, (SELECT count(*) FROM h) AS reviews,
  round(100.0::DOUBLE * (SELECT count(*) FROM h) / count(*), 6) AS review_pct FROM reviews"""))
def repeated_letters(spark, sf):
    return E.pattern_rates(reviews(spark, sf), ["repeated_letters"])


@query("tokens_explode", over(TOKENS, "SELECT token, count(*) AS occurrences FROM (SELECT unnest(words) AS token FROM tokens) GROUP BY token"))
def tokens_explode(spark, sf):
    return E.token_counts(reviews(spark, sf))


@query("vocabulary_summary", over(TOKENS, """
SELECT CAST(sum(len(words)) AS BIGINT) AS words_before, CAST(sum(len(kept)) AS BIGINT) AS words_after,
  count(*) FILTER (WHERE len(words) = 0) AS empty_before, count(*) FILTER (WHERE len(kept) = 0) AS empty_after,
  (SELECT count(DISTINCT w) FROM (SELECT unnest(kept) AS w FROM kept)) AS vocabulary FROM kept"""))
def vocabulary_summary(spark, sf):
    return E.vocabulary_summary(reviews(spark, sf))


@query("word_counts", over(TOKENS, """,
w AS (SELECT source_row, unnest(kept) AS word FROM kept)
SELECT word, count(*) AS occurrences, count(DISTINCT source_row) AS reviews,
  round(100.0::DOUBLE * count(DISTINCT source_row) / (SELECT count(*) FROM reviews), 6) AS review_pct
FROM w GROUP BY word ORDER BY occurrences DESC, word LIMIT 10"""))
def word_counts(spark, sf):
    return E.word_counts(reviews(spark, sf))


@query("bigram_counts", over(TOKENS, """,
b AS (SELECT kept[i] || ' ' || kept[i + 1] AS bigram FROM (SELECT kept, unnest(range(1, len(kept))) AS i FROM kept))
SELECT bigram, count(*) AS occurrences FROM b GROUP BY bigram ORDER BY occurrences DESC, bigram LIMIT 10"""))
def bigram_counts(spark, sf):
    return E.bigram_counts(reviews(spark, sf))


@query("word_contrast", over(TOKENS, """,
n AS (SELECT count(*) FILTER (WHERE rating IN (1, 2)) AS lo, count(*) FILTER (WHERE rating IN (4, 5)) AS hi FROM reviews),
w AS (SELECT DISTINCT source_row, rating <= 2 AS is_low, unnest(kept) AS word FROM kept WHERE rating IN (1, 2, 4, 5)),
c AS (SELECT word, count(*) FILTER (WHERE is_low) AS low_reviews, count(*) FILTER (WHERE NOT is_low) AS high_reviews FROM w GROUP BY word HAVING count(*) >= 10),
p AS (SELECT word, low_reviews, high_reviews, round(low_reviews * 100.0::DOUBLE / lo, 2) AS low_pct, round(high_reviews * 100.0::DOUBLE / hi, 2) AS high_pct,
  round(low_reviews * 100.0::DOUBLE / lo - high_reviews * 100.0::DOUBLE / hi, 2) AS difference FROM c, n)
(SELECT *, 'low' AS side FROM p ORDER BY difference DESC, word LIMIT 10)
UNION ALL (SELECT *, 'high' AS side FROM p ORDER BY difference, word LIMIT 10)"""))
def word_contrast(spark, sf):
    return E.word_contrast(reviews(spark, sf))


@query("rating_by_platform", over(REVIEWS, "SELECT platform, " + ", ".join(
    f"round(100.0::DOUBLE * count(*) FILTER (WHERE rating = {s}) / count(*), 6) AS star_{s}_pct" for s in range(1, 6)
) + " FROM reviews WHERE rating IS NOT NULL GROUP BY platform"))
def rating_by_platform(spark, sf):
    return E.rating_by_platform(reviews(spark, sf))


@query("duplicates_by_platform", over(REVIEWS, """,
d AS (SELECT platform, model_text <> '' AND count(*) OVER (PARTITION BY model_text) > 1 AS repeated FROM reviews)
SELECT platform, count(*) FILTER (WHERE repeated) AS duplicates,
  round(100.0::DOUBLE * count(*) FILTER (WHERE repeated) / count(*), 6) AS duplicate_pct
FROM d GROUP BY platform HAVING count(*) FILTER (WHERE repeated) > 0"""))
def duplicates_by_platform(spark, sf):
    return E.duplicates_by_platform(reviews(spark, sf))


@query("temporal_coverage", over(PREPARED, """
SELECT platform, count(*) AS records, count(record_date) AS valid_dates,
  min(substr(record_date, 1, 10)) AS first_date, max(substr(record_date, 1, 10)) AS last_date FROM prepared GROUP BY platform"""))
def temporal_coverage(spark, sf):
    return E.temporal_coverage(prepared(spark, sf))


@query("dataset_summary", over(PREPARED, """
SELECT 'platform' AS kind, platform AS name, count(*) AS rows FROM prepared GROUP BY platform
UNION ALL SELECT 'month', substr(record_date, 1, 7), count(*) FROM prepared WHERE record_date IS NOT NULL GROUP BY 2
UNION ALL SELECT 'unknown_dates', '', count(*) FILTER (WHERE record_date IS NULL) FROM prepared"""))
def dataset_summary(spark, sf):
    return E.dataset_summary(prepared(spark, sf))


@query("overview_platforms", over(PREPARED, """
SELECT platform, count(*) AS records, min(substr(record_date, 1, 10)) AS first_record, max(substr(record_date, 1, 10)) AS last_record,
  string_agg(DISTINCT preferred_provider, ',' ORDER BY preferred_provider) AS providers, count(rating) AS rated,
  round(avg(rating), 2) AS mean_rating, round(count(*)::DOUBLE / (SELECT count(*) FROM prepared), 4) AS share
FROM prepared GROUP BY platform"""))
def overview_platforms(spark, sf):
    return E.overview_platforms(prepared(spark, sf))


@query("monthly_pivot", over(PREPARED, """,
m AS (SELECT substr(record_date, 1, 7) AS month, count(*) FILTER (WHERE platform = 'app_store') AS app_store,
  count(*) FILTER (WHERE platform = 'google_play') AS google_play, count(*) FILTER (WHERE platform = 'x') AS x,
  count(*) FILTER (WHERE platform = 'youtube') AS youtube, count(platform) AS total
  FROM prepared WHERE record_date IS NOT NULL GROUP BY 1)
SELECT *, month = (SELECT month FROM m ORDER BY total DESC, month LIMIT 1) AS is_peak FROM m"""))
def monthly_pivot(spark, sf):
    return E.monthly_pivot(prepared(spark, sf))


FILLED = ["record_id", "title", "rating", "country", "language", "app_id", "record_date"]


@query("filled_columns", over(PREPARED, " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, round(count({c})::DOUBLE / count(*), 4) AS filled_share FROM prepared" for c in FILLED)))
def filled_columns(spark, sf):
    return E.filled_columns(prepared(spark, sf).select(*FILLED))


@query("provider_counts", over(PREPARED, """
SELECT 'provider' AS kind, preferred_provider AS name, count(*) AS records FROM prepared GROUP BY 2
UNION ALL SELECT 'relevance', relevance, count(*) FROM prepared GROUP BY 2"""))
def provider_counts(spark, sf):
    return E.provider_counts(prepared(spark, sf))
