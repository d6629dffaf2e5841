"""From prepared reviews to vectors: selection, features, encoding with reuse, checks."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.hashing import fingerprint, ordered_digest, text_hash
from ..functions.numbers import n, rounded
from ..session import checkpointed
from .ordered import numbered

# The encoder profile.
DIMENSIONS, MAX_TOKENS = 384, 128
RESERVED = {"source_row", "vector_row", "embedding_text", "source_text_hash", "feature_text_hash"}

Encoder = Callable[[list[str]], tuple[np.ndarray, list[int]]]


# -- selection -------------------------------------------------------------

def validate_reviews(df: DataFrame) -> DataFrame:
    """One row about the whole table: rows, bad ids, all members of repeated ids, bad texts."""
    bad_id = X.is_blank(F.col("record_id"))
    per_id = df.groupBy(F.when(~bad_id, F.col("record_id")).alias("id")).agg(
        n().alias("rows"), n(X.is_blank(F.col("model_text"))).alias("bad_texts")
    )
    return per_id.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("rows"))), F.lit(0)).alias("invalid_id_rows"),
        F.coalesce(F.sum(F.when(F.col("id").isNotNull() & (F.col("rows") > 1), F.col("rows"))), F.lit(0)).alias("duplicate_id_rows"),
        F.coalesce(F.sum("bad_texts"), F.lit(0)).alias("invalid_text_rows"),
    ).withColumn("valid", (F.col("rows") > 0) & (F.col("invalid_id_rows") + F.col("duplicate_id_rows") + F.col("invalid_text_rows") == 0))


def problem_examples(df: DataFrame, order: str, limit: int = 10) -> DataFrame:
    """The first rows with a bad id, a repeated id or a bad text."""
    bad_id, bad_text = X.is_blank(F.col("record_id")), X.is_blank(F.col("model_text"))
    repeated = df.where(~bad_id).groupBy("record_id").agg(n().alias("c")).where(F.col("c") > 1).select("record_id", F.lit(True).alias("repeated"))
    rows = df.select(order, "record_id", bad_id.alias("bad_id"), bad_text.alias("bad_text")).join(repeated, "record_id", "left")
    return rows.where(F.col("bad_id") | F.col("bad_text") | F.col("repeated")).orderBy(order).limit(limit).select(
        order, F.when(F.col("bad_id"), F.concat(F.lit("row "), F.col(order).cast("string"), F.lit(" has no id")))
        .otherwise(F.substring("record_id", 1, 120)).alias("example")
    )


def pin_selection(df: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """Rows in source order with positions ``0 .. n-1``; an explicit limit keeps the first."""
    taken = RESERVED & (set(df.columns) - set(order))
    if taken:
        raise ValueError(f"reserved columns in the source: {sorted(taken)}")
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    rows = numbered(df, order, "pinned_row")
    return rows if limit is None else rows.where(F.col("pinned_row") < limit)


def selection_identity(pinned: DataFrame, limit: int | None) -> DataFrame:
    """Row count, order-sensitive digest and whether the selection is the full table."""
    hashed = pinned.select("pinned_row", "record_id", text_hash(F.col("model_text")).alias("h"))
    return ordered_digest(hashed, "pinned_row", ["record_id", "h"]).withColumn("is_full", F.lit(limit is None))


# -- features --------------------------------------------------------------

def features(pinned: DataFrame) -> DataFrame:
    """Add the exact encoder text and the fingerprints of source and encoder text."""
    return pinned.withColumn("embedding_text", F.col("model_text")).withColumns({
        "source_text_hash": text_hash(F.col("model_text")), "feature_text_hash": text_hash(F.col("embedding_text")),
    })


def feature_counts(featured: DataFrame) -> DataFrame:
    return featured.agg(
        n().alias("rows"), n(F.col("model_text") != F.col("embedding_text")).alias("changed_rows"),
        F.countDistinct("source_text_hash").alias("source_unique_texts"),
        F.countDistinct("feature_text_hash").alias("prepared_unique_texts"),
    )


def unique_texts(featured: DataFrame) -> DataFrame:
    """Each different text once, with the rows it stands for; differing texts under one hash fail."""
    # A second hash tells texts apart without shipping each text twice.
    check = F.xxhash64("embedding_text")
    per_hash = featured.groupBy(F.col("feature_text_hash").alias("input_hash")).agg(
        F.first("embedding_text").alias("text"), F.min(check).alias("_low"), F.max(check).alias("_high"), n().alias("rows")
    )
    return per_hash.withColumn("text", F.when(F.col("_low") == F.col("_high"), F.col("text")).otherwise(
        F.raise_error(F.lit("different texts share a hash")))).drop("_low", "_high")


# -- encoding --------------------------------------------------------------

def bag_encoder(dimensions: int = DIMENSIONS, max_tokens: int = MAX_TOKENS) -> Encoder:
    """Deterministic stand-in for a sentence model: hashed words, unit length.

    Counts tokens like a model would, with the two special ones included, and
    reads the first ``max_tokens`` of them.
    """

    def encode(texts: list[str]) -> tuple[np.ndarray, list[int]]:
        out = np.zeros((len(texts), dimensions), dtype=np.float32)
        counts = []
        for row, text in enumerate(texts):
            tokens = text.lower().split()
            counts.append(len(tokens) + 2)
            for token in tokens[: max_tokens - 2]:
                code = zlib.crc32(token.encode("utf-8"))
                out[row, code % dimensions] += 1.0 if code & 0x80000000 else -1.0
            if not out[row].any():
                out[row, 0] = 1.0
        return out / np.linalg.norm(out, axis=1, keepdims=True), counts

    return encode


def encode_texts(texts: DataFrame, encoder: Encoder) -> DataFrame:
    """``input_hash, vector, tokens`` for ``input_hash, text``, in Arrow batches."""

    def run(batches):
        for batch in batches:
            if len(batch):
                vectors, tokens = encoder(batch["text"].tolist())
                yield pd.DataFrame({"input_hash": batch["input_hash"], "vector": list(np.asarray(vectors, dtype=np.float32)), "tokens": tokens})

    return texts.select("input_hash", "text").mapInPandas(run, "input_hash string, vector array<float>, tokens int")


def cache_plan(unique: DataFrame, cache: DataFrame, encoder_id: str) -> tuple[DataFrame, DataFrame]:
    """Texts whose vector the cache holds for this encoder, and texts to encode."""
    held = cache.where(F.col("encoder_id") == encoder_id).select("input_hash", "vector", "tokens")
    return unique.join(held, "input_hash"), unique.join(held, "input_hash", "left_anti")


def encode_reviews(
    featured: DataFrame, cache: DataFrame, encoder_id: str, encoder: Encoder
) -> tuple[DataFrame, DataFrame]:
    """Vector per row and the cache rows to append; a text is encoded once at most.

    New vectors are pinned, as both results read them.
    Rows meet their vector on the text hash.  A text that fills a large part of
    the table is one vector against many rows, which the skew join splits.
    """
    unique = unique_texts(featured)
    held, missing = cache_plan(unique, cache, encoder_id)
    fresh = checkpointed(encode_texts(missing, encoder))
    known = held.select("input_hash", "vector", "tokens", F.lit(True).alias("reused")).unionByName(
        fresh.withColumn("reused", F.lit(False)))
    rows = featured.join(known.withColumnRenamed("input_hash", "feature_text_hash"), "feature_text_hash")
    return rows, fresh.select(F.lit(encoder_id).alias("encoder_id"), "input_hash", "vector", "tokens")


def encoding_report(encoded: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Rows, different texts, encoded and reused texts, truncation, longest text."""
    per_text = encoded.groupBy("feature_text_hash", "tokens", "reused").agg(n().alias("rows"))
    cut = F.col("tokens") > max_tokens
    return per_text.agg(
        F.sum("rows").alias("rows"), n().alias("unique_texts"), n(~F.col("reused")).alias("encoded_unique"),
        n(F.col("reused")).alias("reused_unique"), n(cut).alias("truncated_unique"),
        F.sum(F.when(cut, F.col("rows")).otherwise(0)).alias("truncated_rows"), F.max("tokens").alias("max_tokens"),
    )


# -- checks ----------------------------------------------------------------

def vector_validation(vectors: DataFrame, vector: str, dimensions: int, tolerance: float = 1e-4) -> DataFrame:
    size = F.size(F.col(vector))
    nonfinite = V.has_nonfinite(F.col(vector))
    return vectors.agg(
        n().alias("rows"), n(F.col(vector).isNull() | (size != dimensions)).alias("wrong_size"),
        n(nonfinite).alias("nonfinite"), n(~nonfinite & (F.abs(V.norm(F.col(vector)) - 1.0) > tolerance)).alias("not_unit"),
    )


def reconcile_release(release: DataFrame, source: DataFrame) -> DataFrame:
    """Broken rules between an embedding release and the source it was pinned from.

    Both sides join on position; the release must be a prefix of the source.
    """
    theirs = source.select("source_row", F.col("record_id").alias("s_id"), F.col("model_text").alias("s_text"))
    both = release.join(theirs, "source_row", "left")
    rules = {
        "hash_of_source_text": text_hash(F.col("model_text")) != F.col("source_text_hash"),
        "hash_of_feature_text": text_hash(F.col("embedding_text")) != F.col("feature_text_hash"),
        "text_policy": F.col("embedding_text") != F.col("model_text"),
        "positions_differ": F.col("vector_row") != F.col("source_row"),
        "not_in_source": ~(F.col("s_id").eqNullSafe(F.col("record_id")) & F.col("s_text").eqNullSafe(F.col("model_text"))),
    }
    counted = both.agg(
        n().alias("rows"), F.countDistinct("source_row").alias("_rows"), F.min("source_row").alias("_low"), F.max("source_row").alias("_high"),
        F.countDistinct("feature_text_hash").alias("unique_texts"), (F.count("record_id") - F.countDistinct("record_id")).alias("repeated_ids"),
        *[n(F.coalesce(test, F.lit(True))).alias(name) for name, test in rules.items()],
    )
    contiguous = (F.col("_low") == 0) & (F.col("_high") == F.col("rows") - 1) & (F.col("_rows") == F.col("rows"))
    return counted.withColumn("contiguous", contiguous).drop("_rows", "_low", "_high")


def attach_context(vectors: DataFrame, context: DataFrame, key: str, platforms: list[str] | None = None) -> DataFrame:
    """Vectors with their review columns; platforms filter rows but keep positions."""
    joined = vectors.join(context, key)
    return joined if platforms is None else joined.where(F.coalesce(F.col("platform").isin(platforms), F.lit(False)))


def context_problems(vectors: DataFrame, context: DataFrame, key: str) -> DataFrame:
    """Keys that break the one-to-one join, counted per kind."""
    left = vectors.groupBy(key).agg(n().alias("l"))
    right = context.groupBy(key).agg(n().alias("r"))
    return left.join(right, key, "full_outer").agg(
        n(F.col("r").isNull()).alias("without_context"), n(F.col("l").isNull()).alias("without_vector"),
        n(F.col("l") > 1).alias("repeated_vectors"), n(F.col("r") > 1).alias("repeated_context"),
    )


def seeded_sample(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """A reproducible sample: the rows with the smallest SHA-256 of seed and key, picked by number in every range."""
    drawn = df.withColumn("_draw", F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")), 256))
    return numbered(drawn, ["_draw", key], "_turn").where(F.col("_turn") < size).drop("_draw", "_turn")


def prepared_inputs(df: DataFrame) -> DataFrame:
    """Rows with text, as encoder input under the hash of that text."""
    body = X.strip(F.coalesce(F.col("model_text"), F.lit("")))
    return df.where(body != "").withColumn("embedding_text", body).withColumn("input_hash", F.col("text_hash"))


def input_summary(inputs: DataFrame) -> DataFrame:
    lengths = inputs.groupBy(F.length("embedding_text").cast("bigint").alias("length")).agg(n().alias("rows"))
    median = lengths.agg(F.percentile("length", F.lit(0.5), F.col("rows")).alias("m")).scalar()
    return inputs.agg(
        n().alias("rows"), (n() - F.countDistinct("input_hash")).alias("duplicate_texts"),
        F.max(F.length("embedding_text")).cast("bigint").alias("max_length"),
    ).withColumn("median_length", rounded(median))


def sample_reconcile(sample: DataFrame, release: DataFrame, key: str = "record_id") -> DataFrame:
    """Sample rows that are missing from, or differ from, their release row."""
    columns = [c for c in sample.columns if c != key]
    theirs = release.select(key, F.lit(True).alias("_found"), F.struct(*columns).alias("_theirs"))
    checked = sample.select(key, F.struct(*columns).alias("_ours")).join(theirs, key, "left")
    per_key = checked.groupBy(key).agg(
        n().alias("rows"), F.bool_or("_found").alias("found"), F.bool_and(F.col("_ours").eqNullSafe(F.col("_theirs"))).alias("equal")
    )
    return per_key.agg(
        F.sum("rows").alias("rows"), n(F.col("rows") > 1).alias("repeated_ids"),
        n(F.col("found").isNull()).alias("missing"), n(F.col("found") & ~F.col("equal")).alias("different"),
    )


def stage_record(df: DataFrame, stage: str, position: str, cells: list[str], values: str | None = None) -> DataFrame:
    """What a stage leaves behind: output fingerprint, rows, non-finite values."""
    bad = F.lit(0).cast("bigint") if values is None else None
    counted = ordered_digest(df, position, cells).withColumnRenamed("digest", "output_digest")
    if values is not None:
        counted = counted.withColumn("nonfinite", df.agg(n(V.has_nonfinite(F.col(values))).alias("b")).scalar())
    else:
        counted = counted.withColumn("nonfinite", bad)
    return counted.withColumn("stage", F.lit(stage))


def stage_lineage(stages: DataFrame) -> DataFrame:
    """Per stage: its recorded input is its upstream's output, same rows, finite, same release.

    ``stages`` carries ``stage, upstream, input_digest, output_digest, rows,
    nonfinite, release_id``.
    """
    up = stages.select(F.col("stage").alias("upstream"), F.col("output_digest").alias("u_digest"), F.col("rows").alias("u_rows"), F.col("release_id").alias("u_release"))
    first = F.col("upstream").isNull()
    return stages.join(up, "upstream", "left").select(
        "stage",
        (first | F.coalesce(F.col("input_digest") == F.col("u_digest"), F.lit(False))).alias("input_matches"),
        (first | F.coalesce(F.col("rows") == F.col("u_rows"), F.lit(False))).alias("rows_match"),
        (F.col("nonfinite") == 0).alias("finite"),
        (first | F.coalesce(F.col("release_id") == F.col("u_release"), F.lit(False))).alias("same_release"),
    )


def identity_of(parts: dict[str, Column]) -> Column:
    """Fingerprint of a named set of settings."""
    return fingerprint(parts)
