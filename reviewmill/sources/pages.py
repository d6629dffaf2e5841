"""Captured store pages as DataFrames of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import dates as D
from ..functions.hashing import author_pseudonym
from ..functions.text import text_or_null

# Shapes of the captured pages.
FEED_ENTRY = (
    "array<struct<`id`:struct<label:string>, `updated`:struct<label:string>, `content`:struct<label:string>, "
    "`title`:struct<label:string>, `im:rating`:struct<label:string>, `im:version`:struct<label:string>, "
    "`im:name`:struct<label:string>, `author`:struct<uri:struct<label:string>>>>"
)
RPC_FRAME = r"\)\]\}'\n\n([\s\S]+)"
REVIEW_ID, SCORE, CONTENT, EDITED, VERSION = 0, 2, 4, 5, 10


def captured_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per captured page file; folders above it name what it holds: ``app_id=``, ``country=``, ``fetched_at=`` (``20300101T000000``)."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("value").alias("body"), F.input_file_name().alias("capture_ref"))
    named = lambda name: F.url_decode(F.nullif(F.regexp_extract("capture_ref", f"/{name}=([^/]+)/", 1), F.lit("")))
    return files.select(
        "body", "capture_ref", named("app_id").alias("app_id"), named("country").alias("country"),
        F.try_to_timestamp(named("fetched_at"), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz").alias("fetched_at"))


def parse_feed_pages(pages: DataFrame, salt: bytes = b"", salt_version: str = "v1") -> DataFrame:
    """Reviews of feed pages; a lone entry counts as a list, app metadata is skipped."""
    entry = F.get_json_object("body", "$.feed.entry")
    as_list = F.when(F.ltrim(entry).startswith("{"), F.concat(F.lit("["), entry, F.lit("]"))).otherwise(entry)
    entries = pages.select("*", F.posexplode(F.arrays_zip(
        F.from_json(as_list, FEED_ENTRY).alias("e"), F.from_json(as_list, "array<string>").alias("raw"))).alias("position", "z")) \
        .select("*", "z.e", "z.raw").drop("z")
    rating = F.col("e.`im:rating`.label")
    is_metadata = F.col("e.`im:rating`").isNull() & F.col("e.`im:name`").isNotNull()
    keep = [c for c in pages.columns if c != "body"]
    return entries.where(~is_metadata).select(
        *keep,
        "position",
        F.lit("apple_rss").alias("provider"),
        F.col("e.id.label").alias("source_id"),
        D.parse_utc(F.col("e.updated.label")).alias("updated_at"),
        text_or_null(F.col("e.content.label")).alias("text"),
        text_or_null(F.col("e.title.label")).alias("title"),
        rating.cast("int").alias("rating"),
        text_or_null(F.col("e.`im:version`.label")).alias("app_version"),
        author_pseudonym(F.col("e.author.uri.label"), salt, salt_version).alias("author_hash"),
        "raw",
    )


def _rpc_payload(body: Column) -> Column:
    frame = F.from_json(F.regexp_extract(body, RPC_FRAME, 1), "array<array<string>>")
    return F.from_json(frame[0][2], "array<string>")


def parse_rpc_pages(pages: DataFrame) -> DataFrame:
    """Reviews of framed call responses: positional arrays inside a JSON string."""
    reviews = pages.withColumn("p", _rpc_payload(F.col("body"))).select(
        "*", F.posexplode(F.arrays_zip(
            F.from_json(F.col("p")[0], "array<array<string>>").alias("r"), F.from_json(F.col("p")[0], "array<string>").alias("raw"))
        ).alias("position", "z")).select("*", "z.r", "z.raw").drop("z")
    epoch = F.from_json(F.col("r")[EDITED], "array<bigint>")[0]
    moment = F.timestamp_seconds(epoch)
    keep = [c for c in pages.columns if c != "body"]
    return reviews.select(
        *keep,
        "position",
        F.lit("play").alias("provider"),
        F.col("r")[REVIEW_ID].alias("source_id"),
        F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz")).alias("updated_at"),
        text_or_null(F.col("r")[CONTENT]).alias("text"),
        F.lit(None).cast("string").alias("title"),
        F.col("r")[SCORE].cast("int").alias("rating"),
        text_or_null(F.get(F.col("r"), F.lit(VERSION))).alias("app_version"),
        F.lit(None).cast("string").alias("author_hash"),
        "raw",
    )


def page_problems(feed: DataFrame, rpc: DataFrame) -> DataFrame:
    """``provider, capture_ref, problem`` of pages that are not what they should be, or end a feed that goes on."""
    broken_feed = feed.where(F.get_json_object("body", "$.feed").isNull()).select(
        F.lit("apple_rss").alias("provider"), "capture_ref", F.lit("malformed").alias("problem"))
    payload = _rpc_payload(F.col("body"))
    reviews = F.from_json(payload[0], "array<array<string>>")
    token = F.try_element_at(F.from_json(F.try_element_at(payload, F.lit(-2)), "array<string>"), F.lit(-1))
    problem = F.when(F.coalesce(F.size(payload), F.lit(0)) < 1, "malformed").when(
        F.coalesce(F.size(reviews), F.lit(0)) < 1, F.when(token.isNotNull(), "empty_with_token"))
    broken_rpc = rpc.select(F.lit("play").alias("provider"), "capture_ref", problem.alias("problem")).where("problem is not null")
    return broken_feed.unionByName(broken_rpc)


def page_observations(feed: DataFrame, rpc: DataFrame, salt: bytes = b"", salt_version: str = "v1") -> DataFrame:
    """The reviews of captured pages as observations with their provenance; ``batch_order`` is the place in the page."""
    rows = parse_feed_pages(feed, salt, salt_version).unionByName(parse_rpc_pages(rpc))
    return rows.withColumn("batch_order", F.col("position").cast("bigint")).select(
        *[F.col(field.name).cast(field.dataType).alias(field.name) for field in S.OBSERVATIONS],
        "author_hash", "capture_ref", "raw")


def continuation(pages: DataFrame) -> DataFrame:
    """Token each framed page continues with; null on the last page."""
    payload = pages.withColumn("p", _rpc_payload(F.col("body")))
    container = F.from_json(F.try_element_at(F.col("p"), F.lit(-2)), "array<string>")
    keep = [c for c in pages.columns if c != "body"]
    return payload.select(*keep, F.try_element_at(container, F.lit(-1)).alias("token"))
