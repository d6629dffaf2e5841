"""The review mart over the scored review view, and the dashboard's questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import mart as D
from ..operators import topics as K
from ..session import lookup, stored, work_path
from ..sources.tables import scored
from .registry import query
from .sentiment import labels
from .topics import LABELS, WEIGHTS, class_weights, topic_rows
from .views import over

# Keywords only name topics that have no label.
MART = WEIGHTS + ", " + LABELS.strip() + """,
dim AS (SELECT n.topic_id, CASE WHEN n.topic_id < 0 THEN 'none' ELSE coalesce(l.assessment, 'unclear') END AS assessment,
  CASE WHEN n.topic_id < 0 THEN 'Unassigned reviews' ELSE coalesce(l.label, array_to_string(k.keywords[1:3], ' · ')) END AS title
  FROM numbers n LEFT JOIN labels_ l ON l.topic_id = n.topic_id LEFT JOIN lists k ON k.topic_id = n.topic_id),
mart AS (SELECT t.record_id, t.source_row, t.text, t.platform, t.topic_id, d.assessment, d.title, t.sentiment, greatest(p_negative, p_neutral, p_positive) AS confidence, t.rating, t.month
  FROM t JOIN dim d ON d.topic_id = t.topic_id)"""
VIEW = D.Filter(platforms=["google_play", "x", "youtube"], sentiments=["negative", "positive"], first_month="2024-01", last_month="2024-01", query="EN")
SEEN = MART + """,
seen AS (SELECT * FROM mart WHERE platform IN ('google_play', 'x', 'youtube') AND sentiment IN ('negative', 'positive') AND month BETWEEN '2024-01' AND '2024-01' AND contains(lower(text), 'en'))"""
MIX = "count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral, count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) AS total"


def mart(spark, sf):
    rows = topic_rows(spark, sf, "dates")
    info = K.keyword_lists(K.keywords(class_weights(rows)))
    topics = K.topic_numbers(rows.select("cluster_id")).select("topic_id").join(info, "topic_id", "left")
    return D.review_mart(scored(rows), lookup(D.topic_dimension(topics, labels(spark, sf))))


_built: dict[tuple[str, str], D.StoredMart] = {}


def stored_mart(spark, sf):
    """The mart on disk, written in two commits when a session first asks for it; every question reads it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _built:
        held = D.StoredMart(work_path(spark, "mart"))
        rows = stored(mart(spark, sf), "mart-rows")
        late = F.pmod(F.xxhash64("record_id"), F.lit(5)) == 0
        # What comes later stood under another platform before.
        before = rows.where(late).withColumn("platform", F.lit("earlier"))
        held.commit(1, rows.where(~late).unionByName(before))
        held.commit(2, rows.where(late), before)
        _built[key] = held
    return _built[key]


@query("review_mart", over(MART, "SELECT record_id, source_row, platform, topic_id, assessment, title, sentiment, round(confidence, 6) AS confidence, rating, month, sha256(text) AS text_hash FROM mart"))
def review_mart(spark, sf):
    return stored_mart(spark, sf).reviews(spark).select("record_id", "source_row", "platform", "topic_id", "assessment", "title", "sentiment", rounded(F.col("confidence")).alias("confidence"),
                         "rating", "month", F.sha2("text", 256).alias("text_hash"))


@query("mart_filter", over(SEEN, "SELECT record_id FROM seen"))
def mart_filter(spark, sf):
    return stored_mart(spark, sf).reviews(spark, VIEW).select("record_id")


@query("mart_mix", over(SEEN, f"SELECT {MIX} FROM seen"))
def mart_mix(spark, sf):
    return D.mix(stored_mart(spark, sf).reviews(spark, VIEW))


@query("mart_kpis", over(SEEN, f""",
k AS (SELECT {MIX}, count(DISTINCT topic_id) FILTER (WHERE topic_id >= 0) AS topics FROM seen)
SELECT total, topics, negative, positive, round(negative::DOUBLE / total, 6) AS negative_share, round(positive::DOUBLE / total, 6) AS positive_share FROM k"""))
def mart_kpis(spark, sf):
    return D.kpis(stored_mart(spark, sf).reviews(spark, VIEW))


STATS = MART + f""",
stats AS (SELECT topic_id, assessment, title, {MIX} FROM mart GROUP BY 1, 2, 3)"""


@query("worst_topic", over(STATS, """
SELECT topic_id, assessment, title, negative, neutral, positive, total, round(negative::DOUBLE / total, 6) AS negative_share, round(positive::DOUBLE / total, 6) AS positive_share, round(bound, 6) AS bound FROM (
  SELECT *, (negative / total::DOUBLE + 3.8416::DOUBLE / (2 * total) - 1.96::DOUBLE * sqrt(negative / total::DOUBLE * (1 - negative / total::DOUBLE) / total + 3.8416::DOUBLE / (4.0::DOUBLE * total * total))) / (1 + 3.8416::DOUBLE / total) AS bound
  FROM stats WHERE topic_id >= 0 AND assessment NOT IN ('unclear', 'none') AND total >= 5) ORDER BY bound DESC, total DESC, topic_id LIMIT 1"""))
def worst_topic(spark, sf):
    return D.worst_topic(stored_mart(spark, sf).counts(spark))


@query("mart_topics", over(STATS, "SELECT *, round(negative::DOUBLE / total, 6) AS negative_share, round(positive::DOUBLE / total, 6) AS positive_share FROM stats"))
def mart_topics(spark, sf):
    return D.sorted_topics(D.topic_stats(stored_mart(spark, sf).counts(spark)), "negative")


TREND = MART + f""",
m AS (SELECT DISTINCT month FROM mart), c AS (SELECT month, {MIX} FROM mart WHERE platform = 'x' GROUP BY 1),
f AS (SELECT m.month, coalesce(negative, 0) AS negative, coalesce(neutral, 0) AS neutral, coalesce(positive, 0) AS positive, coalesce(total, 0) AS total FROM m LEFT JOIN c ON c.month = m.month)"""


@query("mart_trend", over(TREND, "SELECT *, month = (SELECT month FROM f ORDER BY total DESC, month LIMIT 1) AS is_peak FROM f"))
def mart_trend(spark, sf):
    rows = stored_mart(spark, sf).counts(spark)
    return D.trend(D.in_view(rows, D.Filter(platforms=["x"])), rows.select("month").distinct())


@query("mart_platforms", over(SEEN, f"SELECT platform, {MIX}, round(count(*) FILTER (WHERE sentiment = 'negative')::DOUBLE / count(*), 6) AS negative_share FROM seen GROUP BY 1"))
def mart_platforms(spark, sf):
    return D.platforms(stored_mart(spark, sf).reviews(spark, VIEW))


@query("mart_detail_counts", over(MART, """
SELECT count(*) FILTER (WHERE platform = 'x') AS in_view, count(*) AS all_rows, count(*) FILTER (WHERE platform = 'x' AND sentiment = 'negative') AS negative,
  count(*) FILTER (WHERE platform = 'x' AND sentiment = 'neutral') AS neutral, count(*) FILTER (WHERE platform = 'x' AND sentiment = 'positive') AS positive FROM mart WHERE topic_id = 0"""))
def mart_detail_counts(spark, sf):
    return D.detail_counts(stored_mart(spark, sf).counts(spark), D.Filter(platforms=["x"]), 0)


@query("mart_detail", over(MART, """
SELECT record_id, sentiment, round(confidence, 6) AS confidence FROM mart WHERE topic_id = 0
ORDER BY CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END, confidence DESC, source_row LIMIT 6 OFFSET 6"""))
def mart_detail(spark, sf):
    return D.detail_page(stored_mart(spark, sf).reviews(spark), D.Filter(), 0, 1).select("record_id", "sentiment", rounded(F.col("confidence")).alias("confidence"))


@query("mart_cube", over(MART, "SELECT month, platform, sentiment, topic_id, assessment, title, count(*) AS reviews FROM mart GROUP BY ALL"))
def mart_cube(spark, sf):
    """The counts that two commits left, reviews of the second taken out of where the first had them."""
    return stored_mart(spark, sf).counts(spark)


COUNTED = D.Filter(platforms=["x", "youtube"], sentiments=["negative", "neutral"], first_month="2024-01", last_month="2024-12")


@query("mart_cube_kpis", over(MART, f""",
k AS (SELECT {MIX}, count(DISTINCT topic_id) FILTER (WHERE topic_id >= 0) AS topics FROM mart
  WHERE platform IN ('x', 'youtube') AND sentiment IN ('negative', 'neutral') AND month BETWEEN '2024-01' AND '2024-12')
SELECT total, topics, negative, positive, round(negative::DOUBLE / total, 6) AS negative_share, round(positive::DOUBLE / total, 6) AS positive_share FROM k"""))
def mart_cube_kpis(spark, sf):
    """Key figures of a view without a text query, from the counts alone."""
    return D.kpis(D.in_view(stored_mart(spark, sf).counts(spark), COUNTED))
