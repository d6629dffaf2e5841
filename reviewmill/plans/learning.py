"""Relevance and sentiment models over the labelled review view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import text_hash
from ..functions.numbers import n, rounded
from ..operators import models as M
from ..session import checkpointed
from ..sources.tables import reviews, scored, table, vectors
from .exploration import TOKENS
from .registry import query
from .views import REVIEWS, over

LABELLED = REVIEWS + """,
lab AS (SELECT r.*, CASE l.quality WHEN 1 THEN 'relevant' ELSE 'irrelevant' END AS label, l.quality AS target, l.toxic FROM reviews r
  JOIN labels l ON l.doc_id = r.source_row JOIN embeddings v ON v.vec_id = r.source_row),
ls AS (SELECT * FROM lab QUALIFY row_number() OVER (PARTITION BY text ORDER BY source_row) = 1)"""


def labelled(spark, sf):
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("record_id"), F.when(F.col("quality") == 1, "relevant").otherwise("irrelevant").alias("label"), "toxic")
    # Texts only tell copies apart here, so their digests go to the vectors and labels.
    with_vectors = reviews(spark, sf).select("record_id", "source_row", "platform", text_hash(F.col("text")).alias("text")).join(
        vectors(spark, sf).select(F.col("vec_id").alias("source_row"), F.col("embedding").alias("vector")), "source_row")
    return M.labelled_set(labels, with_vectors)


@query("labelled_set", over(LABELLED, "SELECT record_id, platform, label, CAST(target AS INT) AS target FROM ls"))
def labelled_set(spark, sf):
    return labelled(spark, sf).select("record_id", "platform", "label", "target")


@query("label_margins", over(LABELLED, "SELECT coalesce(platform, 'All') AS platform, coalesce(label, 'All') AS label, count(*) AS rows FROM ls GROUP BY CUBE (platform, label)"))
def label_margins(spark, sf):
    return M.label_margins(labelled(spark, sf))


# Scores of one prediction column against the target, in plain SQL.
def scores_sql(rows: str, keys: str = "") -> str:
    by = f"{keys}, " if keys else ""
    join = " AND ".join(f"p.{k.strip()} = s.{k.strip()}" for k in keys.split(",")) if keys else "true"
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
x AS ({rows}), cls AS (SELECT * FROM (VALUES (0), (1)) c(k)),
pc AS (SELECT {by}k, count(*) FILTER (WHERE target = k AND predicted = k) AS hits, count(*) FILTER (WHERE target = k) AS support, count(*) FILTER (WHERE predicted = k) AS called FROM x, cls GROUP BY {by}k),
pr AS (SELECT *, coalesce(hits / nullif(called, 0)::DOUBLE, 0) AS precision, coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS recall FROM pc WHERE support + called > 0),
pf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)
SELECT {by}CAST(sum(support) AS BIGINT) AS rows, round(sum(hits)::DOUBLE / sum(support), 6) AS accuracy, round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy,
  round(coalesce(max(precision) FILTER (WHERE k = 1), 0), 6) AS precision, round(coalesce(max(recall) FILTER (WHERE k = 1), 0), 6) AS recall, round(coalesce(max(f1) FILTER (WHERE k = 1), 0), 6) AS f1,
  round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support)::DOUBLE, 6) AS weighted_f1 FROM pf {group}"""


BASELINE = "SELECT platform, CAST(target AS INT) AS target, CASE WHEN platform = 'x' THEN 1 ELSE 0 END AS predicted FROM ls"


def _baseline(spark, sf):
    return labelled(spark, sf).withColumn("predicted", M.platform_baseline(F.col("platform")))


@query("platform_baseline", over(LABELLED, ", " + scores_sql(BASELINE).strip()))
def platform_baseline(spark, sf):
    return M.summary_scores(M.confusion(_baseline(spark, sf), "target", "predicted"))


# Two made-to-order predictors from other label columns, for the score tables.
TWO = "SELECT platform, record_id, CAST(target AS INT) AS target, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS first, CASE WHEN source_row % 5 = 0 THEN 0 ELSE 1 END AS second FROM ls"


def _two(spark, sf):
    return labelled(spark, sf).withColumns({
        "first": F.when(F.col("toxic") == 1, 0).otherwise(1), "second": F.when(F.col("source_row") % 5 == 0, 0).otherwise(1)})


@query("classification_metrics", over(LABELLED, f""", tw AS ({TWO}),
{scores_sql("SELECT 'first' AS model, target, first AS predicted FROM tw UNION ALL SELECT 'second', target, second FROM tw", "model").strip()}"""))
def classification_metrics(spark, sf):
    return M.summary_scores(M.confusion(_both(spark, sf), "target", "predicted", ["model"]), ["model"])


def _both(spark, sf):
    rows = _two(spark, sf)
    return rows.select("platform", "target", F.explode(F.array(
        F.struct(F.lit("first").alias("model"), F.col("first").alias("predicted")), F.struct(F.lit("second").alias("model"), F.col("second").alias("predicted")),
    )).alias("m")).select("platform", "target", "m.*")


@query("confusion_matrix", over(LABELLED, f", tw AS ({TWO}) SELECT target AS actual, first AS predicted, count(*) AS rows FROM tw GROUP BY 1, 2"))
def confusion_matrix(spark, sf):
    return M.confusion(_two(spark, sf), "target", "first")


@query("metrics_by_platform", over(LABELLED, f""", tw AS ({TWO}),
{scores_sql("SELECT 'first' AS model, platform, target, first AS predicted FROM tw UNION ALL SELECT 'second', platform, target, second FROM tw", "model, platform").strip()}"""))
def metrics_by_platform(spark, sf):
    return M.summary_scores(M.confusion(_both(spark, sf), "target", "predicted", ["model", "platform"]), ["model", "platform"])


@query("shared_errors", over(LABELLED, f", tw AS ({TWO}) SELECT record_id, platform FROM tw WHERE target <> first AND target <> second"))
def shared_errors(spark, sf):
    return M.shared_errors(_two(spark, sf), "first", "second").select("record_id", "platform")


@query("stratified_folds")
def stratified_folds(spark, sf):
    return M.stratified_folds(labelled(spark, sf)).groupBy("platform", "target", "fold").agg(n().alias("rows"))


def _relevance(spark, sf, kind):
    return M.out_of_fold(M.stratified_folds(labelled(spark, sf)), kind)


@query("relevance_logreg")
def relevance_logreg(spark, sf):
    return M.summary_scores(M.confusion(_relevance(spark, sf, "logistic"), "target", "prediction"))


@query("relevance_svm")
def relevance_svm(spark, sf):
    return _relevance(spark, sf, "svm").select("record_id", "platform", "target", "prediction", rounded(F.col("decision_score"), 4).alias("decision_score"))


@query("relevance_gate")
def relevance_gate(spark, sf):
    model = M.fit_relevance(labelled(spark, sf), "svm")
    rows = reviews(spark, sf).select("record_id", "source_row", "platform").join(
        vectors(spark, sf).select(F.col("vec_id").alias("source_row"), F.col("embedding").alias("vector")), "source_row")
    return M.relevance_gate(M.score_relevance(model, rows)).select("record_id", "platform", "prediction")


STARS = REVIEWS + """,
st AS (SELECT record_id, text, CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END AS label FROM reviews WHERE rating IS NOT NULL)"""


def starred(spark, sf):
    return reviews(spark, sf).where(F.col("rating").isNotNull()).select("record_id", "source_row", "text", "platform", M.stars_to_label(F.col("rating")).alias("label"))


@query("stars_to_label", over(STARS, "SELECT record_id, label FROM st"))
def stars_to_label(spark, sf):
    return starred(spark, sf).select("record_id", "label")


@query("grouped_split")
def grouped_split(spark, sf):
    return M.grouped_split(starred(spark, sf), 60, 20, 20).select("record_id", "label", "split")


# A split by row number, so that the expected table can be stated in SQL.
@query("split_distribution", over(STARS, """,
s AS (SELECT label, CASE CAST(record_id AS BIGINT) % 7 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM st),
c AS (SELECT split, label, count(*) AS rows FROM s GROUP BY 1, 2),
d AS (SELECT split, label, rows, round(100.0::DOUBLE * rows / sum(rows) OVER (PARTITION BY split), 6) AS share_pct,
  round(100.0::DOUBLE * sum(rows) OVER (PARTITION BY label) / sum(rows) OVER (), 6) AS source_pct FROM c)
SELECT *, round(share_pct - source_pct, 6) AS difference_pp FROM d"""))
def split_distribution(spark, sf):
    row = F.col("source_row") % 7
    split = F.when(row == 0, "test").when(row == 1, "validation").otherwise("train")
    return M.split_distribution(starred(spark, sf).withColumn("split", split))


@query("sentiment_training")
def sentiment_training(spark, sf):
    rows = scored(reviews(spark, sf)).select("record_id", "source_row", "text", F.col("sentiment").alias("label"))
    split = checkpointed(M.grouped_split(rows, 60, 20, 20))
    base, model, _ = M.train_sentiment(split)
    tested = M.predict_sentiment(base, model, split.where("split = 'test'"))
    adapted = M.summary_scores(M.confusion(tested, "label", "predicted"), positive="positive").withColumn("model", F.lit("adapted"))
    plain = M.summary_scores(M.confusion(tested.withColumn("predicted", F.lit("negative")), "label", "predicted"), positive="positive").withColumn("model", F.lit("one class"))
    return adapted.unionByName(plain)


_hits = ", ".join(f"len(list_filter(words, lambda w: w IN ({', '.join(repr(w) for w in words)}))) AS {name}" for name, words in M.PROFILES.items())


@query("language_audit", over(TOKENS, rf""",
h AS (SELECT {_hits}, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters FROM tokens),
m AS (SELECT *, spanish + english + french + german AS total, greatest(spanish, english, french, german) AS most FROM h),
d AS (SELECT letters, CASE WHEN total = 0 THEN 'unknown' WHEN spanish = most THEN 'spanish' WHEN english = most THEN 'english' WHEN french = most THEN 'french' ELSE 'german' END AS detected_language,
  total, most FROM m),
s AS (SELECT detected_language, CASE WHEN letters < 20 THEN 'too_short' WHEN total = 0 THEN 'unknown' WHEN most / total::DOUBLE < 0.8 THEN 'uncertain'
  WHEN detected_language = 'spanish' THEN 'spanish' ELSE 'other_language' END AS status FROM d)
SELECT status, detected_language, count(*) AS reviews, count(*) AS retained FROM s GROUP BY 1, 2"""))
def language_audit(spark, sf):
    return M.language_counts(M.language_audit(reviews(spark, sf)))
