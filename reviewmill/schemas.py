"""Column contracts and closed sets of the review tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Column orders and closed sets of the published tables.
PREPARED_COLUMNS = [
    "record_id", "platform", "app_id", "country", "text", "title", "model_text",
    "text_hash", "rating", "record_date", "date_basis", "date_precision",
    "date_timezone", "language", "language_basis", "relevance",
    "preferred_provider", "identity_basis",
]
NULLABLE_COLUMNS = {"app_id", "country", "title", "rating", "record_date", "language"}
PLATFORMS = ["app_store", "google_play", "x", "youtube"]
STORE_PLATFORMS = ["app_store", "google_play"]
SOCIAL_PLATFORMS = ["x", "youtube"]
PROVIDERS = ["play", "apple_rss", "appbot", "x", "youtube"]
RELEVANCE = ["app_target_match", "human_relevant", "human_irrelevant", "human_uncertain", "unreviewed"]
DATE_PRECISIONS = ["day", "second", "unknown"]
DATE_SOURCES = {
    "source_updated_at": "updated_at",
    "published_at": "published_at",
    "earliest_observed_edit_family_creation": "published_at",
}
SENTIMENTS = ["negative", "neutral", "positive"]
STATUSES = ["classified", "abstained", "failed", "excluded"]
ASSESSMENTS = ["single_feature", "mixed", "unclear"]
OUTCOMES = ["inserted", "edited", "duplicates", "stale"]
STORE_PROVIDERS = ["apple_rss", "play"]

OBSERVATION_KEY = ["provider", "app_id", "source_id"]
CONTENT_FIELDS = ["text", "title", "rating", "app_version"]
# Where an observation comes from; optional columns that an accepted version keeps under its provider's name.
PROVENANCE = ["author_hash", "run_id", "capture_ref", "raw"]

OBSERVATIONS = T.StructType([
    T.StructField("batch_order", T.LongType()),
    T.StructField("provider", T.StringType()),
    T.StructField("app_id", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("app_version", T.StringType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
])

# One accepted version of a review: canonical columns, then the provider's own.
VERSIONS = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("app_id", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("record_date", T.TimestampNTZType()),
    T.StructField("date_basis", T.StringType()),
    T.StructField("date_precision", T.StringType()),
    T.StructField("date_timezone", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("language_basis", T.StringType()),
    T.StructField("relevance", T.StringType()),
    T.StructField("preferred_provider", T.StringType()),
    T.StructField("identity_basis", T.StringType()),
    T.StructField("source_count", T.IntegerType()),
    T.StructField("source_record_ids", T.ArrayType(T.StringType())),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("collected_at", T.TimestampNTZType()),
    T.StructField("native", T.MapType(T.StringType(), T.StringType())),
    T.StructField("seq", T.LongType()),
])

IDENTITIES = T.StructType([
    T.StructField("provider", T.StringType()),
    T.StructField("app_id", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("record_id", T.StringType()),
])
