"""The review mart and the questions a dashboard asks of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.numbers import n, ratio, rounded, wilson_low
from .ordered import page
from .sentiment import confidence, label_index

UNASSIGNED_TITLE = "Unassigned reviews"
PAGE = 6
# Stated, so month folders are read back as text.
MART_SCHEMA = (
    "record_id string, source_row bigint, text string, platform string, topic_id int, assessment string, "
    "title string, sentiment string, confidence double, rating int, month string"
)


REVIEW_SCHEMA = MART_SCHEMA.replace(", month string", "")
CUBE_KEYS = ["month", "platform", "sentiment", "topic_id", "assessment", "title"]
CUBE_SCHEMA = "platform string, sentiment string, topic_id int, assessment string, title string, reviews bigint"


def topic_dimension(topics: DataFrame, labels: DataFrame) -> DataFrame:
    """Topics with assessment and title; ``topics`` carries ``topic_id, keywords``."""
    loose = F.col("topic_id") < 0
    words = F.array_join(F.slice("keywords", 1, 3), " · ")
    return topics.join(labels.select("topic_id", "label", F.col("assessment").alias("_a")), "topic_id", "left").select(
        "topic_id", F.slice("keywords", 1, 6).alias("keywords"), F.col("label").alias("feature"),
        F.when(loose, "none").otherwise(F.coalesce("_a", F.lit("unclear"))).alias("assessment"),
        F.when(loose, UNASSIGNED_TITLE).otherwise(F.coalesce("label", words)).alias("title"),
    )


def review_mart(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """One row per review with its topic, name, label and month."""
    return rows.drop("title", "assessment").join(dimension.select("topic_id", "assessment", "title"), "topic_id", "left").select(
        "record_id", "source_row", "text", "platform", "topic_id", F.coalesce("assessment", F.lit("none")).alias("assessment"),
        "title", "sentiment", confidence().alias("confidence"), "rating", "month",
    )


def cube_of(mart: DataFrame) -> DataFrame:
    """How many reviews share month, platform, label and topic: all that counts and shares need."""
    return mart.groupBy(*CUBE_KEYS).agg(n().alias("reviews"))


@dataclass(frozen=True)
class StoredMart:
    """A mart on disk: reviews in month folders and their counts, both growing by commits.

    Counts add up, so a commit writes the counts of its own rows and nothing that is there is read or written again.
    Rows and counts of a commit lie in folders of its number; a commit that is made again replaces its own.  A review
    that a commit changes is given as it stood before, too: that row counts minus one and hides the earlier one.
    """

    path: str

    def commit(self, number: int, rows: DataFrame, removed: DataFrame | None = None) -> None:
        """Add reviews, and take out what stood for them before."""
        counts, signed = cube_of(rows), rows.withColumn("sign", F.lit(1))
        if removed is not None:
            counts = counts.unionByName(cube_of(removed).withColumn("reviews", -F.col("reviews")))
            signed = signed.unionByName(removed.withColumn("sign", F.lit(-1)))
        # A month's rows spread over several files, however many it has.
        signed.repartition("month", F.pmod(F.xxhash64("record_id"), F.lit(64))).write.mode("overwrite").partitionBy("month") \
            .parquet(f"{self.path}/reviews/commit={number}")
        counts.coalesce(1).write.mode("overwrite").partitionBy("month").parquet(f"{self.path}/counts/commit={number}")

    def counts(self, spark: SparkSession) -> DataFrame:
        """The cube: ``CUBE_KEYS, reviews``; a view without a text query is answered from it."""
        rows = spark.read.schema(f"{CUBE_SCHEMA}, commit bigint, month string").parquet(f"{self.path}/counts")
        return rows.groupBy(*CUBE_KEYS).agg(F.sum("reviews").alias("reviews")).where(F.col("reviews") != 0)

    def reviews(self, spark: SparkSession, view: Filter | None = None) -> DataFrame:
        """The reviews of a view; only its months' folders are read."""
        rows = spark.read.schema(f"{REVIEW_SCHEMA}, sign int, commit bigint, month string").parquet(f"{self.path}/reviews")
        rows = rows if view is None else rows.where(view.condition())
        gone = rows.where("sign < 0").groupBy("record_id").agg(F.max("commit").alias("upto"))
        return rows.where("sign > 0").join(gone, "record_id", "left").where(
            F.col("upto").isNull() | (F.col("commit") >= F.col("upto"))).drop("sign", "commit", "upto")


@dataclass(frozen=True)
class Filter:
    """What is in view; ``None`` means everything."""

    platforms: list[str] | None = None
    sentiments: list[str] | None = None
    assessments: list[str] | None = None
    first_month: str | None = None
    last_month: str | None = None
    query: str = ""

    def condition(self) -> Column:
        test = F.lit(True)
        for column, values in (("platform", self.platforms), ("sentiment", self.sentiments), ("assessment", self.assessments)):
            if values is not None:
                test = test & F.col(column).isin(values)
        if self.first_month is not None:
            test = test & (F.col("month") >= self.first_month)
        if self.last_month is not None:
            test = test & (F.col("month") <= self.last_month)
        if self.query:
            test = test & F.contains(F.lower("text"), F.lit(self.query.lower()))
        return test


def in_view(mart: DataFrame, view: Filter) -> DataFrame:
    return mart.where(view.condition())


def _size(rows: DataFrame, test: Column | None = None) -> Column:
    """Reviews behind rows, of a mart or of its cube."""
    weight = F.col("reviews") if "reviews" in rows.columns else F.lit(1).cast("bigint")
    return F.coalesce(F.sum(weight if test is None else F.when(test, weight)), F.lit(0).cast("bigint"))


def _mix(rows: DataFrame) -> list[Column]:
    return [_size(rows, F.col("sentiment") == k).alias(k) for k in S.SENTIMENTS] + [_size(rows).alias("total")]


def mix(rows: DataFrame) -> DataFrame:
    return rows.agg(*_mix(rows))


def kpis(rows: DataFrame) -> DataFrame:
    """Reviews, topics represented, negative and positive counts and shares."""
    return rows.agg(*_mix(rows), F.countDistinct(F.when(F.col("topic_id") >= 0, F.col("topic_id"))).alias("topics")).select(
        "total", "topics", "negative", "positive",
        ratio(F.col("negative"), F.col("total")).alias("negative_share"), ratio(F.col("positive"), F.col("total")).alias("positive_share"),
    )


def topic_stats(rows: DataFrame) -> DataFrame:
    stats = rows.groupBy("topic_id", "assessment", "title").agg(*_mix(rows))
    return stats.withColumns({
        "negative_share": ratio(F.col("negative"), F.col("total")), "positive_share": ratio(F.col("positive"), F.col("total")),
    })


def sorted_topics(stats: DataFrame, by: str = "volume") -> DataFrame:
    """By size, negative share or positive share; unassigned reviews always last."""
    keys = [F.col("topic_id") < 0]
    if by in ("negative", "positive"):
        keys.append(F.desc(f"{by}_share"))
    return stats.orderBy(*keys, F.desc("total"), "topic_id")


def worst_topic(rows: DataFrame, least: int = 5) -> DataFrame:
    """The feature topic whose negative share is surely high: Wilson bound, then size."""
    named = topic_stats(rows).where(
        (F.col("topic_id") >= 0) & ~F.col("assessment").isin("unclear", "none") & (F.col("total") >= least))
    bound = wilson_low(F.col("negative"), F.col("total"))
    return named.withColumn("bound", rounded(bound)).orderBy(bound.desc(), F.desc("total"), "topic_id").limit(1)


def trend(rows: DataFrame, months: DataFrame, view: Filter = Filter()) -> DataFrame:
    """Labels per month, months without rows kept, the first busiest month marked."""
    inside = months.where(Filter(first_month=view.first_month, last_month=view.last_month).condition())
    counted = rows.groupBy("month").agg(*_mix(rows))
    filled = inside.select("month").join(counted, "month", "left").na.fill(0, [*S.SENTIMENTS, "total"])
    peak = filled.agg(F.min_by("month", F.struct((-F.col("total")).alias("t"), F.col("month").alias("m"))).alias("p")).scalar()
    return filled.withColumn("is_peak", F.col("month") == peak)


def platforms(rows: DataFrame) -> DataFrame:
    return rows.groupBy("platform").agg(*_mix(rows)).withColumn("negative_share", ratio(F.col("negative"), F.col("total")))


def detail_counts(mart: DataFrame, view: Filter, topic: int) -> DataFrame:
    """Of one topic: rows in view, all rows, labels in view."""
    test = view.condition()
    return mart.where(F.col("topic_id") == topic).agg(
        _size(mart, test).alias("in_view"), _size(mart).alias("all_rows"),
        *[_size(mart, test & (F.col("sentiment") == k)).alias(k) for k in S.SENTIMENTS])


def detail_page(mart: DataFrame, view: Filter, topic: int, number: int = 0, size: int = PAGE) -> DataFrame:
    """One page of a topic's reviews: negative first, most confident first."""
    rows = in_view(mart, view).where(F.col("topic_id") == topic)
    order = [label_index(F.col("sentiment")).asc(), F.desc("confidence"), F.asc("source_row")]
    return page(rows, order, number, size)
