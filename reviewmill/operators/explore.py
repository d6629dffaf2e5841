"""Exploratory statistics of a review table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import dates as D
from ..functions import text as X
from ..functions.numbers import n, ratio, rounded

# The text patterns counted, in Java regular-expression syntax.
PATTERNS = {
    "repeated_marks": r"[!?¡¿]{2,}",
    "upper_case": r"(?U)\b[A-ZÁÉÍÓÚÜÑ]{2,}\b",
    "negations": r"(?iU)\b(?:no|nunca|jamás|tampoco|sin|ni)\b",
    "emoji": r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]",
    "links": r"https?://\S+|www\.\S+",
    "amounts": r"(?U)\$\s*\d[\d,]*(?:\.\d{1,2})?",
    "repeated_letters": r"([\p{L}\p{Nl}\p{No}])\1{2,}",
}
UNKNOWN_LANGUAGE = "desconocido"


def text_length() -> Column:
    return F.length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint")


def _digest(column: Column) -> Column:
    """A 32-byte stand-in for a value, so distinct counts never shuffle texts."""
    return F.unhex(F.sha2(column.cast("string"), 256))


def column_profile(df: DataFrame) -> DataFrame:
    """Type, nulls, null share and distinct values of every column."""
    totals = df.agg(n().alias("_rows"), *[F.count(c).alias(f"f_{c}") for c in df.columns])
    parts = [
        f"'{f.name}', '{f.dataType.simpleString()}', f_{f.name}" for f in df.schema.fields
    ]
    filled = totals.selectExpr(
        "_rows", f"stack({len(parts)}, {', '.join(parts)}) AS (column_name, data_type, filled)"
    )
    # One long (column, value) list instead of one distinct aggregate per column.
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _digest(F.col(c)).alias("value")) for c in df.columns
    ])).alias("pair")).select("pair.*").where(F.col("value").isNotNull())
    distinct = pairs.groupBy("column_name", "value").agg(F.lit(1).alias("one")).groupBy("column_name").agg(n().alias("distinct_values"))
    missing = F.col("_rows") - F.col("filled")
    return filled.join(distinct, "column_name", "left").select(
        "column_name", "data_type", missing.alias("missing"),
        ratio(missing, F.col("_rows"), 100).alias("missing_pct"),
        F.coalesce("distinct_values", F.lit(0).cast("bigint")).alias("distinct_values"),
    )


def quality_controls(df: DataFrame) -> DataFrame:
    """Rows, missing and repeated ids, blank and repeated texts, changed texts."""
    body, prepared = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("model_text"), F.lit(""))
    text_key = F.when(X.strip(prepared) != "", _digest(prepared))
    return df.agg(
        n().alias("rows"),
        n(F.col("record_id").isNull()).alias("missing_ids"),
        (F.count("record_id") - F.countDistinct("record_id")).alias("repeated_ids"),
        n(X.strip(body) == "").alias("blank_texts"),
        n(X.strip(prepared) == "").alias("blank_prepared_texts"),
        (F.count(text_key) - F.countDistinct(text_key)).alias("repeated_prepared_texts"),
        n(body != prepared).alias("changed_texts"),
    )


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    counted = df.agg(*[F.countDistinct(c).alias(c) for c in columns])
    parts = ", ".join(f"'{c}', {c}" for c in columns)
    return counted.selectExpr(f"stack({len(columns)}, {parts}) AS (column_name, distinct_values)")


def platform_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("platform").agg(
        n().alias("reviews"), F.count("rating").alias("rated"), F.round(F.avg("rating"), 2).alias("mean_rating"),
    )


def value_counts(df: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    """Rows per value; a null counts under ``missing`` or stays null."""
    value = F.col(column) if missing is None else F.coalesce(F.col(column), F.lit(missing))
    return df.groupBy(value.alias(column)).agg(n().alias("reviews"))


def language_summary(df: DataFrame) -> DataFrame:
    return value_counts(df, "language", UNKNOWN_LANGUAGE)


def rating_histogram(df: DataFrame) -> DataFrame:
    """Rows per star, one to five, zeros included."""
    counts = df.agg(*[n(F.col("rating") == star).alias(f"s{star}") for star in range(1, 6)])
    return counts.selectExpr("stack(5, " + ", ".join(f"{s}, s{s}" for s in range(1, 6)) + ") AS (rating, reviews)")


def length_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width bins between the shortest and the longest text; the last bin is closed."""
    lengths = df.groupBy(text_length().alias("length")).agg(n().alias("reviews"))
    edges = lengths.agg(F.struct(F.min("length").alias("low"), F.max("length").alias("high")).alias("edge")).scalar()
    placed = lengths.withColumn("edge", edges)
    low, high = F.col("edge.low"), F.col("edge.high")
    width = (high - low) / F.lit(float(bins))
    slot = F.when(high == low, 0).otherwise(
        F.least(F.floor((F.col("length") - low) * F.lit(bins) / (high - low)), F.lit(bins - 1))
    ).cast("int")
    counts = placed.groupBy(slot.alias("bin")).agg(F.sum("reviews").alias("reviews"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").withColumn("edge", edges).select(
        "bin", rounded(low + F.col("bin") * width).alias("bin_start"),
        rounded(low + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("reviews", F.lit(0).cast("bigint")).alias("reviews"),
    )


def _length_counts(df: DataFrame, *keys: Column) -> DataFrame:
    """Rows per length: quantiles then read this small table, not the reviews."""
    return df.groupBy(*keys, text_length().alias("length")).agg(n().alias("reviews"))


def iqr_outliers(df: DataFrame) -> DataFrame:
    """Quartiles of text length, fences at 1.5 times their range, rows beyond."""
    lengths = _length_counts(df)
    quartiles = lengths.agg(F.percentile("length", F.array(F.lit(0.25), F.lit(0.75)), F.col("reviews")).alias("q")).scalar()
    q1, q3 = F.col("q")[0], F.col("q")[1]
    spread = q3 - q1
    low, high = q1 - 1.5 * spread, q3 + 1.5 * spread
    beyond = (F.col("length") < low) | (F.col("length") > high)
    return lengths.withColumn("q", quartiles).groupBy("q").agg(
        F.sum("reviews").alias("rows"), F.sum(F.when(beyond, F.col("reviews")).otherwise(0)).alias("outliers"),
    ).select(
        rounded(q1).alias("q1"), rounded(q3).alias("q3"), rounded(spread).alias("iqr"),
        rounded(low).alias("lower_fence"), rounded(high).alias("upper_fence"),
        "outliers", ratio(F.col("outliers"), F.col("rows"), 100).alias("outlier_pct"),
    )


def length_skew(df: DataFrame) -> DataFrame:
    """Bias-adjusted skewness of length and of ``log(1 + length)``."""
    rows = F.count(F.lit(1)).cast("double")
    adjust = F.sqrt(rows * (rows - 1)) / F.nullif(rows - 2, F.lit(0.0))
    length = text_length().cast("double")
    return df.agg(
        rounded(F.skewness(length) * adjust, 4).alias("length_skew"),
        rounded(F.skewness(F.log1p(length)) * adjust, 4).alias("log_length_skew"),
    )


def star_group(rating: Column) -> Column:
    return F.when(rating <= 2, "1-2").when(rating <= 3, "3").otherwise("4-5")


def length_by_rating(df: DataFrame) -> DataFrame:
    """Count, mean, median and longest text per star and per star group."""
    rated = df.where(F.col("rating").isNotNull())
    per_star = _length_counts(rated, F.col("rating"))
    both = per_star.select(F.explode(F.array(
        F.concat(F.lit("star "), F.col("rating").cast("string")),
        F.concat(F.lit("group "), star_group(F.col("rating"))),
    )).alias("bucket"), "length", "reviews")
    return both.groupBy("bucket").agg(
        F.sum("reviews").alias("reviews"),
        rounded(F.sum(F.col("length") * F.col("reviews")) / F.sum("reviews")).alias("mean_length"),
        rounded(F.percentile("length", F.lit(0.5), F.col("reviews"))).alias("median_length"),
        F.max("length").alias("max_length"),
    )


def pattern_rates(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Reviews that match each text pattern, in one scan."""
    chosen = names or list(PATTERNS)
    body = F.coalesce(F.col("text"), F.lit(""))
    counted = df.agg(n().alias("_rows"), *[n(body.rlike(PATTERNS[p])).alias(p) for p in chosen])
    parts = ", ".join(f"'{p}', {p}" for p in chosen)
    return counted.selectExpr("_rows", f"stack({len(chosen)}, {parts}) AS (pattern, reviews)").select(
        "pattern", "reviews", ratio(F.col("reviews"), F.col("_rows"), 100).alias("review_pct")
    )


def tokenized(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", X.words(F.col("text"))).withColumn(
        "kept", X.without(F.col("tokens"), X.EXPLORATION_STOP_WORDS)
    )


def token_counts(df: DataFrame) -> DataFrame:
    """Occurrences of every token before stop words are removed."""
    return df.select(F.explode(X.words(F.col("text"))).alias("token")).groupBy("token").agg(n().alias("occurrences"))


def vocabulary_summary(df: DataFrame) -> DataFrame:
    """Tokens before and after stop words, vocabulary size, reviews left empty."""
    tokens = tokenized(df)
    totals = tokens.agg(
        F.sum(F.size("tokens")).alias("words_before"), F.sum(F.size("kept")).alias("words_after"),
        n(F.size("tokens") == 0).alias("empty_before"), n(F.size("kept") == 0).alias("empty_after"),
    )
    vocabulary = tokens.select(F.explode("kept").alias("word")).agg(F.countDistinct("word").alias("v")).scalar()
    return totals.withColumn("vocabulary", vocabulary)


def word_counts(df: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent words, with the reviews that hold them and their share."""
    rows = df.agg(n().alias("n")).scalar()
    kept = df.select(X.kept_words(F.col("text")).alias("kept"))
    # Each word once per occurrence and once more per review: one pass, one shuffle.
    marks = F.concat(
        F.transform("kept", lambda w: F.struct(w.alias("word"), F.lit(1).alias("here"), F.lit(0).alias("review"))),
        F.transform(F.array_distinct("kept"), lambda w: F.struct(w.alias("word"), F.lit(0).alias("here"), F.lit(1).alias("review"))),
    )
    counted = kept.select(F.explode(marks).alias("m")).groupBy(F.col("m.word").alias("word")).agg(
        F.sum("m.here").alias("occurrences"), F.sum("m.review").alias("reviews"))
    best = counted.orderBy(F.desc("occurrences"), "word").limit(top)
    return best.withColumn("review_pct", ratio(F.col("reviews"), rows, 100))


def bigram_counts(df: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent neighbouring pairs after stop words."""
    pairs = df.select(F.explode(X.bigrams(X.kept_words(F.col("text")))).alias("bigram"))
    return pairs.groupBy("bigram").agg(n().alias("occurrences")).orderBy(F.desc("occurrences"), "bigram").limit(top)


def word_contrast(df: DataFrame, top: int = 10, least: int = 10) -> DataFrame:
    """Words that set low-star reviews apart from high-star ones, both ends."""
    low, high = F.col("rating").isin(1, 2), F.col("rating").isin(4, 5)
    rated = df.where(low | high).select(low.alias("is_low"), X.kept_words(F.col("text")).alias("kept"))
    sizes = df.agg(F.struct(n(low).alias("low"), n(high).alias("high")).alias("n")).scalar()
    words = rated.select("is_low", F.explode(F.array_distinct("kept")).alias("word")).groupBy("word").agg(
        n(F.col("is_low")).alias("low_reviews"), n(~F.col("is_low")).alias("high_reviews"),
    ).where(F.col("low_reviews") + F.col("high_reviews") >= least).withColumn("n", sizes)
    low_pct = F.coalesce(F.col("low_reviews") * 100.0 / F.nullif(F.col("n.low"), F.lit(0)), F.lit(0.0))
    high_pct = F.coalesce(F.col("high_reviews") * 100.0 / F.nullif(F.col("n.high"), F.lit(0)), F.lit(0.0))
    compared = words.select(
        "word", "low_reviews", "high_reviews", rounded(low_pct, 2).alias("low_pct"),
        rounded(high_pct, 2).alias("high_pct"), rounded(low_pct - high_pct, 2).alias("difference"),
    )
    lows = compared.orderBy(F.desc("difference"), "word").limit(top).withColumn("side", F.lit("low"))
    highs = compared.orderBy("difference", "word").limit(top).withColumn("side", F.lit("high"))
    return lows.unionByName(highs)


def rating_by_platform(df: DataFrame) -> DataFrame:
    """Star distribution per platform in percent of its rated rows."""
    counts = df.where(F.col("rating").isNotNull() & F.col("platform").isNotNull()).groupBy("platform").agg(
        n().alias("rated"), *[n(F.col("rating") == s).alias(f"s{s}") for s in range(1, 6)]
    )
    return counts.select("platform", *[ratio(F.col(f"s{s}"), F.col("rated"), 100).alias(f"star_{s}_pct") for s in range(1, 6)])


def duplicates_by_platform(df: DataFrame) -> DataFrame:
    """Rows whose prepared text occurs more than once, per platform.

    Copies are first counted per (text, platform), so a text that fills a large
    part of the table is one row per platform before the texts are compared.
    """
    key = F.when(~X.is_blank(F.col("model_text")), _digest(F.col("model_text")))
    per_text = df.groupBy(key.alias("text_key"), "platform").agg(n().alias("copies"))
    texts = per_text.groupBy("text_key").agg(F.collect_list(F.struct("platform", "copies")).alias("parts"), F.sum("copies").alias("all_copies"))
    parts = texts.select("text_key", "all_copies", F.explode("parts").alias("part")).select("text_key", "all_copies", "part.*")
    repeated = F.col("text_key").isNotNull() & (F.col("all_copies") > 1)
    return parts.groupBy("platform").agg(
        F.sum(F.when(repeated, F.col("copies")).otherwise(0)).alias("duplicates"), F.sum("copies").alias("reviews"),
    ).where((F.col("duplicates") > 0) & F.col("platform").isNotNull()).select(
        "platform", "duplicates", ratio(F.col("duplicates"), F.col("reviews"), 100).alias("duplicate_pct")
    )


def temporal_coverage(df: DataFrame) -> DataFrame:
    moment = D.parse_utc(F.col("record_date"))
    return df.where(F.col("platform").isNotNull()).groupBy("platform").agg(
        n().alias("records"), F.count(moment).alias("valid_dates"),
        D.day(F.min(moment)).alias("first_date"), D.day(F.max(moment)).alias("last_date"),
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows per platform and per UTC month, and rows without a readable date."""
    month = D.month(D.parse_utc(F.col("record_date")))
    counted = df.groupBy("platform", month.alias("month")).agg(n().alias("rows"))
    kinds = counted.select(F.explode(F.array(
        F.struct(F.lit("platform").alias("kind"), F.col("platform").alias("name"), F.col("rows").alias("rows")),
        F.struct(F.lit("month").alias("kind"), F.col("month").alias("name"), F.col("rows").alias("rows")),
        F.struct(F.lit("unknown_dates").alias("kind"), F.lit("").alias("name"),
                 F.when(F.col("month").isNull(), F.col("rows")).otherwise(0).alias("rows")),
    )).alias("k")).select("k.*")
    return kinds.where(F.col("name").isNotNull()).groupBy("kind", "name").agg(F.sum("rows").alias("rows"))


def overview_platforms(df: DataFrame) -> DataFrame:
    """Per platform: rows, share, date range, providers, rated rows, mean rating."""
    moment = D.parse_utc(F.col("record_date"))
    rows = df.agg(n().alias("n")).scalar()
    return df.where(F.col("platform").isNotNull()).groupBy("platform").agg(
        n().alias("records"), D.day(F.min(moment)).alias("first_record"), D.day(F.max(moment)).alias("last_record"),
        F.array_join(F.sort_array(F.collect_set("preferred_provider")), ",").alias("providers"),
        F.count("rating").alias("rated"), F.round(F.avg("rating"), 2).alias("mean_rating"),
    ).withColumn("share", ratio(F.col("records"), rows, 1, 4))


def monthly_pivot(df: DataFrame) -> DataFrame:
    """Rows per month and platform, with the month total and the peak month marked."""
    month = D.month(D.parse_utc(F.col("record_date")))
    wide = df.where(month.isNotNull()).groupBy(month.alias("month")).agg(
        *[n(F.col("platform") == p).alias(p) for p in S.PLATFORMS], F.count("platform").alias("total")
    )
    peak = wide.agg(F.min_by("month", F.struct((-F.col("total")).alias("t"), F.col("month").alias("m"))).alias("p")).scalar()
    return wide.withColumn("is_peak", F.col("month") == peak)


def filled_columns(df: DataFrame) -> DataFrame:
    """Non-null values and their share per column."""
    counted = df.agg(n().alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    parts = ", ".join(f"'{c}', {c}" for c in df.columns)
    return counted.selectExpr("_rows", f"stack({len(df.columns)}, {parts}) AS (column_name, non_null)").select(
        "column_name", "non_null", ratio(F.col("non_null"), F.col("_rows"), 1, 4).alias("filled_share")
    )


def provider_counts(df: DataFrame) -> DataFrame:
    """Rows per provider and per relevance label."""
    return df.groupBy("preferred_provider", "relevance").agg(n().alias("rows")).select(F.explode(F.array(
        F.struct(F.lit("provider").alias("kind"), F.col("preferred_provider").alias("name"), "rows"),
        F.struct(F.lit("relevance").alias("kind"), F.col("relevance").alias("name"), "rows"),
    )).alias("k")).select("k.*").where(F.col("name").isNotNull()).groupBy("kind", "name").agg(F.sum("rows").alias("records"))
