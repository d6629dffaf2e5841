"""Review views over the driver's Parquet tables.

``reviews`` carries the review columns the operators expect.  A join is added
only for the parts a job asks for, so a scan of texts never drags in the event,
label or vector tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import text_hash


#: About 1 GB at the usual split size.
FEW_SPLITS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core where a small table is a few splits only; from ``FEW_SPLITS`` on a scan passes as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else df


def reviews(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """Review rows; ``parts`` may name ``dates``, ``relevance`` and ``groups``."""
    doc = F.col("doc_id")
    in_store = doc % 4 < 2
    documents = spread(table(spark, sf_dir, "documents"), "doc_id").select(
        doc.cast("string").alias("record_id"),
        doc.alias("source_row"),
        F.when(doc % 4 == 0, "google_play").when(doc % 4 == 1, "app_store")
        .when(doc % 4 == 2, "x").otherwise("youtube").alias("platform"),
        F.when(in_store, (F.floor(doc / 4.0) % 5 + 1).cast("int")).alias("rating"),
        "text",
        F.when(in_store, F.col("source")).alias("title"),
        F.col("lang").alias("language"),
        F.col("source").alias("app_id"),
        F.when(in_store, F.lit("MX")).alias("country"),
        F.when(doc % 4 == 0, "play").when(doc % 4 == 1, "apple_rss")
        .when(doc % 4 == 2, "x").otherwise("youtube").alias("preferred_provider"),
    )
    rows = documents.withColumn("model_text", X.strip(F.col("text"))) \
        .withColumn("text_hash", text_hash(F.col("model_text")))
    if "dates" in parts:
        events = table(spark, sf_dir, "events").select(
            F.col("event_id").alias("source_row"), F.col("ts").alias("record_ts")
        )
        rows = rows.join(events, "source_row", "left").withColumn(
            "month", F.date_format("record_ts", "yyyy-MM")
        )
    if "relevance" in parts:
        labels = table(spark, sf_dir, "labels").select(
            F.col("doc_id").alias("source_row"), F.col("quality").alias("quality")
        )
        rows = rows.join(labels, "source_row", "left").withColumn(
            "relevance",
            F.when(F.col("quality") == 1, "human_relevant")
            .when(F.col("quality") == 0, "human_irrelevant").otherwise("unreviewed"),
        ).drop("quality")
    if "groups" in parts:
        grouped = table(spark, sf_dir, "embeddings").select(
            F.col("vec_id").alias("source_row"),
            F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster_id"),
        )
        rows = rows.join(grouped, "source_row", "left").withColumn(
            "cluster_id", F.coalesce(F.col("cluster_id"), F.lit(-1))
        ).withColumn("probability", F.round((F.col("source_row") * 37 % 101) / 100.0, 2))
    return rows


def scored(rows: DataFrame) -> DataFrame:
    """Add three class probabilities and the winning label, derived from the row number."""
    row = F.col("source_row")
    weights = {
        "p_negative": (row * 7 % 11 + 1).cast("double"),
        "p_neutral": (row * 5 % 13 + 1).cast("double"),
        "p_positive": (row * 3 % 17 + 1).cast("double"),
    }
    total = weights["p_negative"] + weights["p_neutral"] + weights["p_positive"]
    rows = rows.withColumns({name: weight / total for name, weight in weights.items()})
    return rows.withColumn(
        "sentiment",
        F.when(
            (F.col("p_negative") >= F.col("p_neutral")) & (F.col("p_negative") >= F.col("p_positive")), "negative"
        ).when(F.col("p_neutral") >= F.col("p_positive"), "neutral").otherwise("positive"),
    )


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as collected: dates as text with their provenance."""
    row, moment = F.col("source_row"), F.col("record_ts")
    stamp = F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    rows = reviews(spark, sf_dir, "dates", "relevance")
    return rows.select(
        "record_id", "source_row", "platform", "app_id", "country", "text", "title", "rating",
        F.when(row % 3 == 1, stamp).otherwise(F.date_format(moment, "yyyy-MM-dd")).alias("record_date"),
        F.lit("source_updated_at").alias("date_basis"),
        F.when(moment.isNull(), "unknown").when(row % 3 < 2, "second").otherwise("day").alias("date_precision"),
        F.lit("UTC").alias("date_timezone"),
        stamp.alias("updated_at"),
        F.lit(None).cast("string").alias("published_at"),
        "language",
        F.lit("detected").alias("language_basis"),
        "relevance", "preferred_provider",
        F.lit("provider_identity").alias("identity_basis"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as fetched reviews: one author is one review, in event order."""
    event = F.col("event_id").cast("bigint")
    return table(spark, sf_dir, "events").select(
        event.alias("batch_order"),
        F.when(F.col("user_id") % 2 == 0, "play").otherwise("apple_rss").alias("provider"),
        F.concat(F.lit("app"), (F.col("user_id") % 3).cast("string")).alias("app_id"),
        F.col("user_id").cast("string").alias("source_id"),
        F.lit("mx").alias("country"),
        F.col("event_type").alias("text"),
        F.lit(None).cast("string").alias("title"),
        (F.col("user_id") % 5 + 1).cast("int").alias("rating"),
        F.lit("1.0").alias("app_version"),
        # Edit dates are whole days and every seventh fetch brings an old one,
        # so duplicate and stale rows occur.
        F.when(event % 7 == 3, F.date_trunc("day", F.col("ts")).cast("timestamp_ntz") - F.expr("INTERVAL 3 DAYS"))
        .otherwise(F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")).alias("updated_at"),
        F.col("ts").alias("fetched_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
