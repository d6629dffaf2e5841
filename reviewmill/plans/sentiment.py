"""Sentiment reports over the scored review view."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import evidence as Ev
from ..operators import sentiment as Se
from ..sources.tables import reviews, scored
from .registry import query
from .topics import LABELS, REPS, TOPICS, interpreted, reps, topic_rows
from .views import REVIEWS, over

NAMED = TOPICS + ", " + LABELS.strip()
BIG = "big AS (SELECT topic_id, reviews FROM numbers WHERE topic_id >= 0 ORDER BY reviews DESC, topic_id LIMIT 5)"


def rows(spark, sf):
    return scored(topic_rows(spark, sf))


def toy_predictor(texts: list[str]) -> np.ndarray:
    """Deterministic class shares from letter counts; stands in for a model."""
    counts = np.array([[1 + t.count("a"), 1 + t.count("e"), 1 + t.count("o")] for t in texts], dtype=float)
    return counts / counts.sum(axis=1, keepdims=True)


LETTERS = """,
c AS (SELECT record_id, platform, 1 + length(text) - length(replace(text, 'a', '')) AS a, 1 + length(text) - length(replace(text, 'e', '')) AS e,
  1 + length(text) - length(replace(text, 'o', '')) AS o FROM reviews)"""


@query("classify_sentiment", over(REVIEWS, LETTERS + """
SELECT record_id, CASE WHEN a >= e AND a >= o THEN 'negative' WHEN e >= o THEN 'neutral' ELSE 'positive' END AS label, 'classified' AS status,
  round(a::DOUBLE / (a + e + o), 6) AS p_negative FROM c"""))
def classify_sentiment(spark, sf):
    return Se.classify(reviews(spark, sf), toy_predictor, "text").select("record_id", "label", "status", rounded(F.col("p_negative")).alias("p_negative"))


def shifted_predictor(texts: list[str]) -> np.ndarray:
    return toy_predictor(texts)[:, [1, 2, 0]]


@query("sentiment_by_domain", over(REVIEWS, LETTERS + """
SELECT record_id, CASE WHEN platform IN ('google_play', 'app_store') THEN 'stores' ELSE 'social' END AS domain,
  CASE WHEN platform IN ('google_play', 'app_store') THEN CASE WHEN a >= e AND a >= o THEN 'negative' WHEN e >= o THEN 'neutral' ELSE 'positive' END
  ELSE CASE WHEN e >= o AND e >= a THEN 'negative' WHEN o >= a THEN 'neutral' ELSE 'positive' END END AS label FROM c"""))
def sentiment_by_domain(spark, sf):
    return Se.classify_by_domain(reviews(spark, sf), {"stores": toy_predictor, "social": shifted_predictor}, "text").select("record_id", "domain", "label")


@query("sentiment_argmax", over(REVIEWS, "SELECT record_id, sentiment AS label FROM reviews"))
def sentiment_argmax(spark, sf):
    return scored(reviews(spark, sf)).select("record_id", Se.argmax_label().alias("label"))


@query("softmax_scores", over(REVIEWS, """,
x AS (SELECT record_id, (source_row % 11) / 4.0::DOUBLE AS neg, (source_row % 13) / 5.0::DOUBLE AS neu, (source_row % 17) / 6.0::DOUBLE AS pos FROM reviews)
SELECT record_id, round(exp(neg) / (exp(neg) + exp(neu) + exp(pos)), 6) AS p_negative, round(exp(neu) / (exp(neg) + exp(neu) + exp(pos)), 6) AS p_neutral,
  round(exp(pos) / (exp(neg) + exp(neu) + exp(pos)), 6) AS p_positive FROM x"""))
def softmax_scores(spark, sf):
    row = F.col("source_row")
    scores = reviews(spark, sf).select("record_id", (row % 13 / 5.0).alias("NEU"), (row % 17 / 6.0).alias("POS"), (row % 11 / 4.0).alias("NEG"))
    names = {"negative": "NEG", "neutral": "NEU", "positive": "POS"}
    return scores.select("record_id", *[rounded(c).alias(name) for name, c in Se.softmax(names).items()])


def _flawed(spark, sf):
    """Predictions with some records spoiled by their row number."""
    row = F.col("source_row")
    base = scored(reviews(spark, sf)).select("record_id", "source_row", *Se.PROBABILITIES, F.col("sentiment").alias("label"))
    return base.select(
        "record_id",
        F.when(row % 10 == 1, F.col("p_negative") + 0.5).otherwise(F.col("p_negative")).alias("p_negative"),
        F.when(row % 10 == 2, F.lit(None)).otherwise(F.col("p_neutral")).alias("p_neutral"),
        "p_positive",
        F.when(row % 10 == 3, "failed").otherwise("classified").alias("status"),
        F.when(row % 10 == 4, "neutral").otherwise(F.col("label")).alias("label"),
        F.lit(None).cast("string").alias("reason"),
    )


@query("sentiment_violations", over(REVIEWS, """,
f AS (SELECT record_id, source_row % 10 AS k, CASE WHEN source_row % 10 = 1 THEN p_negative + 0.5 ELSE p_negative END AS pn, p_neutral AS pu, p_positive AS pp, sentiment FROM reviews),
g AS (SELECT *, CASE WHEN pn >= pu AND pn >= pp THEN 'negative' WHEN pu >= pp THEN 'neutral' ELSE 'positive' END AS winner, CASE WHEN k = 4 THEN 'neutral' ELSE sentiment END AS label FROM f)
SELECT record_id, 'probabilities_incomplete' AS rule FROM g WHERE k = 2
UNION ALL SELECT record_id, 'classified_without_probabilities' FROM g WHERE k = 2
UNION ALL SELECT record_id, 'probability_out_of_range' FROM g WHERE k <> 2 AND (pn > 1 OR pu > 1 OR pp > 1)
UNION ALL SELECT record_id, 'probabilities_do_not_sum' FROM g WHERE k <> 2 AND abs(pn + pu + pp - 1) > 1e-6
UNION ALL SELECT record_id, 'label_is_not_the_winner' FROM g WHERE k NOT IN (2, 3) AND label <> winner
UNION ALL SELECT record_id, 'label_without_classification' FROM g WHERE k = 3
UNION ALL SELECT record_id, 'reason_missing' FROM g WHERE k = 3"""))
def sentiment_violations(spark, sf):
    return Se.prediction_problems(_flawed(spark, sf))


@query("prediction_join", "SELECT count(*) FILTER (WHERE source = 'news') AS missing, 0::BIGINT AS unexpected, count(*) FILTER (WHERE lang = 'de' AND source <> 'news') AS duplicate_predictions, 0::BIGINT AS duplicate_reviews FROM documents")
def prediction_join(spark, sf):
    ours = reviews(spark, sf).select("record_id", "app_id", "language")
    kept = ours.where(F.col("app_id") != "news")
    return Se.join_problems(ours, kept.unionByName(kept.where(F.col("language") == "de")))


@query("topic_sentiment", over(TOPICS, """,
p AS (SELECT topic_id, CASE source_row % 10 WHEN 8 THEN 'failed' WHEN 9 THEN 'excluded' ELSE 'classified' END AS status, sentiment AS label FROM t WHERE topic_id >= 0),
c AS (SELECT topic_id, count(*) AS assigned, count(*) FILTER (WHERE status = 'classified') AS classified, 0::BIGINT AS abstained, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'excluded') AS excluded, count(*) FILTER (WHERE status = 'classified' AND label = 'negative') AS negative,
  count(*) FILTER (WHERE status = 'classified' AND label = 'neutral') AS neutral, count(*) FILTER (WHERE status = 'classified' AND label = 'positive') AS positive FROM p GROUP BY 1)
SELECT *, round(classified::DOUBLE / assigned, 6) AS classified_fraction, round(negative::DOUBLE / classified, 6) AS negative_share, round(neutral::DOUBLE / classified, 6) AS neutral_share,
  round(positive::DOUBLE / classified, 6) AS positive_share, round((positive - negative)::DOUBLE / classified, 6) AS net_sentiment FROM c"""))
def topic_sentiment(spark, sf):
    row = F.col("source_row") % 10
    status = F.when(row == 8, "failed").when(row == 9, "excluded").otherwise("classified")
    return Se.topic_sentiment(rows(spark, sf).select("topic_id", status.alias("status"), F.col("sentiment").alias("label")))


def labels(spark, sf):
    return Ev.label_summary(interpreted(spark, sf)).select("topic_id", "label", "assessment")


CROSS = NAMED + """,
ct AS (SELECT topic_id, count(*) AS reviews, count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
  count(*) FILTER (WHERE sentiment = 'positive') AS positive FROM t GROUP BY 1),
st AS (SELECT ct.*, round(negative::DOUBLE / ct.reviews, 6) AS negative_share, round(neutral::DOUBLE / ct.reviews, 6) AS neutral_share, round(positive::DOUBLE / ct.reviews, 6) AS positive_share,
  CASE WHEN ct.topic_id = -1 THEN '(unassigned)' ELSE coalesce(l.label, '—') END AS feature, CASE WHEN ct.topic_id = -1 THEN '—' ELSE l.assessment END AS assessment
  FROM ct LEFT JOIN labels_ l ON l.topic_id = ct.topic_id)"""


@query("sentiment_by_topic", over(CROSS, "SELECT * FROM st"))
def sentiment_by_topic(spark, sf):
    return Se.sentiment_by_topic(rows(spark, sf), labels(spark, sf))


@query("most_negative_large_topic", over(CROSS, "SELECT * FROM st WHERE topic_id >= 0 AND reviews >= 30 ORDER BY negative_share DESC, reviews DESC, topic_id LIMIT 1"))
def most_negative_large_topic(spark, sf):
    return Se.most_negative_large_topic(Se.sentiment_by_topic(rows(spark, sf), labels(spark, sf)))


@query("sentiment_overall", over(REVIEWS, "SELECT sentiment, count(*) AS reviews, round(count(*)::DOUBLE / (SELECT count(*) FROM reviews), 6) AS share FROM reviews GROUP BY 1"))
def sentiment_overall(spark, sf):
    return Se.overall_mix(scored(reviews(spark, sf)))


@query("rating_sentiment", over(REVIEWS, """,
c AS (SELECT rating, count(*) AS reviews, count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
  count(*) FILTER (WHERE sentiment = 'positive') AS positive FROM reviews WHERE rating IS NOT NULL GROUP BY 1)
SELECT *, round(negative::DOUBLE / reviews, 6) AS negative_share, round(neutral::DOUBLE / reviews, 6) AS neutral_share, round(positive::DOUBLE / reviews, 6) AS positive_share FROM c"""))
def rating_sentiment(spark, sf):
    return Se.rating_sentiment(scored(reviews(spark, sf)))


@query("rating_agreement", over(REVIEWS, """
SELECT count(*) AS rated, round(count(*) FILTER (WHERE sentiment = CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END)::DOUBLE / count(*), 6) AS agreement,
  count(*) FILTER (WHERE rating <> 3 AND sentiment <> 'neutral') AS polar,
  round(count(*) FILTER (WHERE rating <> 3 AND sentiment <> 'neutral' AND (rating <= 2) = (sentiment = 'negative'))::DOUBLE / count(*) FILTER (WHERE rating <> 3 AND sentiment <> 'neutral'), 6) AS polar_agreement
FROM reviews WHERE rating IS NOT NULL"""))
def rating_agreement(spark, sf):
    return Se.rating_agreement(scored(reviews(spark, sf)))


@query("rating_disagreement", over(REVIEWS, """,
o AS (SELECT length(text) AS n FROM reviews WHERE rating = 5 AND sentiment = 'neutral')
SELECT count(*) AS reviews, round(median(n)::DOUBLE, 6) AS median_length, list(n ORDER BY n)[count(*) // 2 + 1] AS upper_median_length FROM o""".replace("count(*) // 2", "CAST(floor(count(*) / 2) AS BIGINT)")))
def rating_disagreement(spark, sf):
    return Se.rating_disagreement(scored(reviews(spark, sf)))


@query("disagreement_examples", over(REVIEWS, """
SELECT record_id, substr(text, 1, 60) AS excerpt, round(p_neutral, 6) AS p_neutral, round(p_positive, 6) AS p_positive FROM reviews
WHERE rating = 5 AND sentiment = 'neutral' ORDER BY source_row LIMIT 6"""))
def disagreement_examples(spark, sf):
    found = Se.disagreement_examples(scored(reviews(spark, sf)))
    return found.withColumn("p_neutral", rounded(F.col("p_neutral"))).withColumn("p_positive", rounded(F.col("p_positive")))


@query("sentiment_members", over(TOPICS, """
SELECT record_id, sentiment, round(greatest(p_negative, p_neutral, p_positive), 6) AS confidence FROM t WHERE topic_id = 1"""))
def sentiment_members(spark, sf):
    members = rows(spark, sf).where(F.col("topic_id") == 1)
    return members.orderBy(*Se.member_order()).select("record_id", "sentiment", rounded(Se.confidence()).alias("confidence"))


@query("sentiment_margin", over(REVIEWS, """
SELECT record_id, round(list_sort([p_negative, p_neutral, p_positive], 'DESC')[1] - list_sort([p_negative, p_neutral, p_positive], 'DESC')[2], 6) AS margin FROM reviews"""))
def sentiment_margin(spark, sf):
    return scored(reviews(spark, sf)).select("record_id", rounded(Se.margin()).alias("margin"))


@query("top_topic_reviews", over(TOPICS, f", {BIG} SELECT count(*) AS rows, count(DISTINCT topic_id) AS topics, CAST((SELECT sum(reviews) FROM big) AS BIGINT) AS expected, true AS complete FROM t WHERE topic_id IN (SELECT topic_id FROM big)"))
def top_topic_reviews(spark, sf):
    return Se.top_topic_check(rows(spark, sf), Ev.largest_topics(rows(spark, sf), 5))


@query("topic_sentiment_pct", over(TOPICS, f""", {BIG}
SELECT topic_id, round(100.0::DOUBLE * count(*) FILTER (WHERE sentiment = 'negative') / count(*), 6) AS negative_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE sentiment = 'neutral') / count(*), 6) AS neutral_pct,
  round(100.0::DOUBLE * count(*) FILTER (WHERE sentiment = 'positive') / count(*), 6) AS positive_pct FROM t WHERE topic_id IN (SELECT topic_id FROM big) GROUP BY 1"""))
def topic_sentiment_pct(spark, sf):
    return Se.topic_sentiment_pct(rows(spark, sf), Ev.largest_topics(rows(spark, sf), 5))


@query("spread_examples", over(REPS, """,
ranked AS (SELECT topic_id, row_number() OVER (ORDER BY reviews DESC, topic_id) - 1 AS pos, least(count(*) OVER (), 20) AS n FROM numbers WHERE topic_id >= 0
  QUALIFY row_number() OVER (ORDER BY reviews DESC, topic_id) <= 20),
wanted AS (SELECT topic_id FROM ranked WHERE list_contains(list_transform(range(0, least(n, 6)), lambda i: CAST(floor(i * (n - 1) / greatest(least(n, 6) - 1, 1)) AS BIGINT)), pos))
SELECT t.topic_id, t.record_id, t.sentiment, round(p_negative, 6) AS p_negative FROM t JOIN wanted w ON w.topic_id = t.topic_id LEFT JOIN reps r ON r.source_row = t.source_row
QUALIFY row_number() OVER (PARTITION BY t.topic_id ORDER BY r.source_row IS NULL, t.source_row) = 1"""))
def spread_examples(spark, sf):
    plain, chosen = reps(spark, sf)
    return Se.spread_examples(scored(plain), Ev.largest_topics(plain), chosen).select("topic_id", "record_id", "sentiment", rounded(F.col("p_negative")).alias("p_negative"))


@query("sentiment_picks", over(TOPICS, """,
c AS (SELECT *, greatest(p_negative, p_neutral, p_positive) AS confidence FROM t)
SELECT topic_id, sentiment AS pick, record_id, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, sentiment ORDER BY confidence DESC, source_row) AS k FROM c QUALIFY k = 1)
UNION ALL SELECT topic_id, 'five_star_neutral_' || k, record_id, round(confidence, 6) FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY confidence DESC, source_row) AS k FROM c WHERE rating = 5 AND sentiment = 'neutral' QUALIFY k <= 2)"""))
def sentiment_picks(spark, sf):
    return Se.topic_picks(rows(spark, sf))
