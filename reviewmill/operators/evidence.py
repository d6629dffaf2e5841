"""Evidence for topic names, checks of the answers, and the tables built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..functions.hashing import text_hash
from ..functions.numbers import n
from ..session import lookup
from .ordered import top_per_group

# How much evidence a request holds, and the answer's shape.
REVIEWS, CHARACTERS = 6, 900
DISTINCT_REVIEWS, DISTINCT_CHARACTERS, LARGEST_TOPICS = 5, 600, 20
RESPONSE = "struct<proposed_feature:string, topic_description:string, supporting_review_ids:array<string>, assessment:string>"


def _prioritised(rows: DataFrame, representative: DataFrame) -> DataFrame:
    first = lookup(representative.select("source_row", F.col("rank").alias("_first")))
    return rows.where(F.col("topic_id") >= 0).join(first, "source_row", "left").withColumn(
        "_first", F.coalesce("_first", F.lit(1 << 30)))


def topic_evidence(
    rows: DataFrame, representative: DataFrame, firmest: bool = True, reviews: int = REVIEWS, characters: int = CHARACTERS
) -> DataFrame:
    """Representatives first, then the firmest (or earliest) members, under short aliases."""
    order = [F.asc("_first"), *([F.desc("probability")] if firmest else []), F.asc("source_row")]
    chosen = top_per_group(_prioritised(rows, representative), ["topic_id"], order, reviews)
    excerpt, cut = X.excerpt(F.col("text"), characters)
    return chosen.select(
        "topic_id", F.concat(F.lit("e"), F.col("rank").cast("string")).alias("alias"), "rank", "record_id",
        excerpt.alias("excerpt"), cut.alias("truncated"),
    )


def largest_topics(rows: DataFrame, limit: int = LARGEST_TOPICS) -> DataFrame:
    sizes = rows.where(F.col("topic_id") >= 0).groupBy("topic_id").agg(n().alias("reviews"))
    return sizes.orderBy(F.desc("reviews"), "topic_id").limit(limit)


def distinct_evidence(
    rows: DataFrame, representative: DataFrame, limit: int = LARGEST_TOPICS,
    reviews: int = DISTINCT_REVIEWS, characters: int = DISTINCT_CHARACTERS,
) -> DataFrame:
    """Different texts only, for the largest topics.

    Copies collapse to their first row before the shuffle.
    """
    wanted = rows.join(lookup(largest_topics(rows, limit).select("topic_id")), "topic_id", "left_semi")
    best = _prioritised(wanted, representative).groupBy("topic_id", text_hash(F.col("text")).alias("_text")).agg(
        F.min(F.struct("_first", "source_row")).alias("at"), F.min_by(F.struct("record_id", "text"), F.struct("_first", "source_row")).alias("r"))
    # Copies share their best priority but are cited by the first row that holds the text.
    first_row = wanted.groupBy("topic_id", text_hash(F.col("text")).alias("_text")).agg(F.min_by("record_id", "source_row").alias("cited"))
    ranked = top_per_group(best.join(first_row, ["topic_id", "_text"]), ["topic_id"], [F.asc("at._first"), F.asc("at.source_row")], reviews)
    excerpt, cut = X.excerpt(F.col("r.text"), characters)
    return ranked.select("topic_id", "rank", F.col("cited").alias("record_id"), excerpt.alias("excerpt"), cut.alias("truncated"))


# -- answers ---------------------------------------------------------------

def parsed_responses(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn("r", F.from_json("response", RESPONSE))


def response_problems(attempts: DataFrame) -> DataFrame:
    """Every rule an answer breaks; ``attempts`` carries ``response`` and ``evidence`` ids."""
    r = parsed_responses(attempts)
    cited = F.coalesce(F.col("r.supporting_review_ids"), F.array().cast("array<string>"))
    rules = {
        "not_an_object": F.col("r.assessment").isNull() & F.col("r.topic_description").isNull(),
        "unknown_assessment": ~F.coalesce(F.col("r.assessment").isin(S.ASSESSMENTS), F.lit(False)),
        "empty_description": F.coalesce(F.length("r.topic_description"), F.lit(0)) == 0,
        "no_citation": F.size(cited) == 0,
        "repeated_citation": F.size(F.array_distinct(cited)) < F.size(cited),
        "foreign_citation": F.size(F.array_except(cited, F.col("evidence"))) > 0,
        "feature_must_be_null": F.col("r.assessment").isin("mixed", "unclear") & F.col("r.proposed_feature").isNotNull(),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return r.withColumn("rule", F.explode(broken)).select("topic_id", "attempt_id", "rule")


def latest_interpretation(topics: DataFrame, attempts: DataFrame) -> DataFrame:
    """The newest attempt of each topic; a topic without one stays pending."""
    newest = attempts.groupBy("topic_id").agg(
        F.max_by(F.struct("attempt_id", "created_at", "status", "response"), F.struct("created_at", "attempt_id")).alias("a"))
    return topics.join(newest, "topic_id", "left").select(
        *topics.columns, F.col("a.attempt_id").alias("attempt_id"),
        F.coalesce("a.status", F.lit("pending")).alias("interpretation_status"),
        F.when(F.col("a.status") == "completed", F.from_json("a.response", RESPONSE)).alias("r"),
    )


def pending_requests(requests: DataFrame, answered: DataFrame) -> DataFrame:
    """Requests without a stored answer for the same evidence."""
    return requests.join(answered.select("fingerprint"), "fingerprint", "left_anti")


def label_summary(interpreted: DataFrame) -> DataFrame:
    """Label (or a dash), assessment and citations of every named topic."""
    named = interpreted.where(F.col("r").isNotNull())
    return named.select(
        "topic_id", "reviews", F.coalesce("r.proposed_feature", F.lit("—")).alias("label"),
        F.col("r.assessment").alias("assessment"), F.size("r.supporting_review_ids").alias("cited"),
    )


def assessment_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("assessment").agg(n().alias("topics"), F.sum("reviews").alias("reviews"))


def labels_by_assessment(labels: DataFrame, keyword_lists: DataFrame, assessment: str | None) -> DataFrame:
    rows = labels if assessment is None else labels.where(F.col("assessment") == assessment)
    return rows.join(keyword_lists, "topic_id", "left").withColumn(
        "keywords", F.array_join(F.slice("keywords", 1, 4), " · "))


def join_topic_sentiment(topics: DataFrame, summaries: DataFrame) -> DataFrame:
    """Topics with their summary on run and topic; ``problem`` names what broke.

    Both sides carry ``topic_run_id, topic_id, dataset_release_id``.
    """
    keys = ["topic_run_id", "topic_id"]
    counted = summaries.groupBy(*keys).agg(n().alias("copies"), F.max("dataset_release_id").alias("s_release"), F.max("net_sentiment").alias("net_sentiment"))
    joined = topics.join(counted, keys, "full_outer")
    return joined.withColumn(
        "problem",
        F.when(F.col("dataset_release_id").isNull(), "unexpected_summary").when(F.col("copies").isNull(), "missing_summary")
        .when(F.col("copies") > 1, "duplicate_summary").when(F.col("s_release") != F.col("dataset_release_id"), "release_differs"),
    ).drop("copies", "s_release")
