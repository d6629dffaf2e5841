"""Preparation of collected reviews into the checked 18-column table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import dates as D
from ..functions import text as X
from ..functions.hashing import text_hash
from ..functions.numbers import n


@dataclass(frozen=True)
class Rules:
    """What to keep. ``None`` turns a filter off; an empty list matches nothing."""

    platforms: list[str] = field(default_factory=lambda: list(S.PLATFORMS))
    language_filter: list[str] | None = None
    relevance_filter: list[str] | None = None
    combine_title_body: bool = False
    columns: list[str] = field(default_factory=lambda: list(S.PREPARED_COLUMNS))
    blank_text: str = "exclude_and_report"

    def __post_init__(self):
        if self.columns != S.PREPARED_COLUMNS:
            raise ValueError("the prepared table has 18 columns in a fixed order")
        if self.blank_text != "exclude_and_report":
            raise ValueError("unsupported blank text rule")
        if not isinstance(self.combine_title_body, bool):
            raise ValueError("combine_title_body must be true or false")
        unknown = set(self.platforms) - set(S.PLATFORMS)
        if unknown:
            raise ValueError(f"unknown platforms: {sorted(unknown)}")
        for name in ("language_filter", "relevance_filter"):
            if getattr(self, name) is not None and not isinstance(getattr(self, name), list):
                raise ValueError(f"{name} must be a list or None")

    @classmethod
    def of(cls, settings: dict | None) -> "Rules":
        unknown = set(settings or {}) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown preparation rules: {sorted(unknown)}")
        return cls(**(settings or {}))


@dataclass
class Prepared:
    data: DataFrame
    excluded: DataFrame
    report: DataFrame


def _isin(column: Column, values: list[str]) -> Column:
    return F.coalesce(column.isin(values), F.lit(False)) if values else F.lit(False)


def exclusion_reason(rules: Rules) -> Column:
    """Blank text wins over the platform filter, which wins over the value filters."""
    reason = F.when(X.is_blank(F.col("text")), "blank_text").when(
        ~_isin(F.col("platform"), rules.platforms), "platform_filter"
    )
    if rules.language_filter is not None:
        reason = reason.when(~_isin(F.col("language"), rules.language_filter), "language_filter")
    if rules.relevance_filter is not None:
        reason = reason.when(~_isin(F.col("relevance"), rules.relevance_filter), "relevance_filter")
    return reason


def _recovered() -> Column:
    """The source stamp a truncated second-precision date stands for."""
    stamp = F.lit(None).cast("string")
    for basis, column in S.DATE_SOURCES.items():
        stamp = F.when(F.col("date_basis") == basis, F.col(column)).otherwise(stamp)
    return stamp


def recover_dates(raw: DataFrame) -> DataFrame:
    """Restore seconds cut from dates and flag every row whose date breaks the rules.

    Adds ``date_error`` (null when fine) and ``date_recovered``; excluded rows
    are checked too, so run this before any filter.
    """
    value, precision = F.col("record_date"), F.col("date_precision")
    cut = (precision == "second") & (F.length(value) == 10)
    source = _recovered()
    full = F.when(cut, source).otherwise(value)
    usable = source.isNotNull() & (F.length(source) > 10)
    error = (
        F.when(value.isNull(), F.when(~precision.eqNullSafe("unknown"), "missing_date"))
        .when(precision == "second",
              F.when(cut & ~usable, "no_source_stamp")
              .when(D.parse_utc(full).isNull(), "invalid_stamp")
              .when(~D.has_offset(full) & ~F.col("date_timezone").eqNullSafe("unknown"), "timezone_mismatch"))
        .when(precision == "day",
              F.when(F.length(value) != 10, "not_a_day").when(D.parse_utc(value).isNull(), "invalid_day"))
        .when(~precision.eqNullSafe("unknown"), "invalid_precision")
    )
    return raw.withColumns({
        "date_error": error,
        "date_recovered": F.coalesce(cut & usable, F.lit(False)),
        "record_date": F.when((precision == "second") & value.isNotNull(), D.iso_text(full)).otherwise(value),
    })


def model_text(combine_title_body: bool) -> Column:
    body = X.strip(F.col("text"))
    if not combine_title_body:
        return body
    title = X.strip(F.coalesce(F.col("title"), F.lit("")))
    return F.when(title != "", F.concat(title, F.lit("\n"), body)).otherwise(body)


def staged(raw: DataFrame, rules: Rules) -> DataFrame:
    """All rows with recovered dates, the exclusion reason and the prepared text."""
    missing = set(S.PREPARED_COLUMNS) - {"model_text", "text_hash"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    for column in set(S.DATE_SOURCES.values()) - set(raw.columns):
        raw = raw.withColumn(column, F.lit(None).cast("string"))
    return recover_dates(raw).withColumns({
        "reason": exclusion_reason(rules),
        "model_text": model_text(rules.combine_title_body),
    })


def prepared_rows(raw: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The kept rows in the fixed column order and types (no checks)."""
    kept = staged(raw, rules or Rules()).where(F.col("reason").isNull())
    kept = kept.withColumn("text_hash", text_hash(F.col("model_text")))
    return kept.select(*[
        F.col(c).cast("int" if c == "rating" else "string").alias(c) for c in S.PREPARED_COLUMNS
    ])


def excluded_rows(raw: DataFrame, rules: Rules | None = None) -> DataFrame:
    return staged(raw, rules or Rules()).where(F.col("reason").isNotNull()).select(
        F.col("record_id").cast("string").alias("record_id"), "reason"
    )


def value_rules() -> dict[str, Column]:
    """Named checks of a kept row; each is true where the row breaks the rule."""
    checks = {
        "rating_out_of_range": F.col("rating").isNotNull() & ~F.col("rating").isin(1, 2, 3, 4, 5),
        "invalid_platform": ~_isin(F.col("platform"), S.PLATFORMS),
        "invalid_provider": ~_isin(F.col("preferred_provider"), S.PROVIDERS),
        "invalid_relevance": ~_isin(F.col("relevance"), S.RELEVANCE),
        "invalid_precision": ~_isin(F.col("date_precision"), S.DATE_PRECISIONS),
    }
    for column in S.PREPARED_COLUMNS:
        if column not in S.NULLABLE_COLUMNS and column != "text_hash":
            checks[f"null_{column}"] = F.col(column).isNull()
    return checks


def violations(raw: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row per broken rule: date rules on all rows, value rules on kept rows."""
    rows = staged(raw, rules or Rules())
    kept = F.col("reason").isNull()
    broken = F.array_compact(F.array(
        F.when(F.col("record_id").isNull(), F.lit("null_record_id")),
        F.when(F.col("date_error").isNotNull(), F.concat(F.lit("date_"), F.col("date_error"))),
        *[F.when(kept & test, F.lit(name)) for name, test in value_rules().items() if name != "null_record_id"],
    ))
    single = rows.select("record_id", F.explode(broken).alias("rule"))
    repeated = raw.groupBy("record_id").agg(n().alias("copies")).where(
        (F.col("copies") > 1) & F.col("record_id").isNotNull()
    ).select("record_id", F.lit("duplicate_record_id").alias("rule"))
    return single.unionByName(repeated)


def report(raw: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Counts of one preparation run, overall and per platform, in one pass."""
    rows = staged(raw, rules or Rules())
    kept = F.col("reason").isNull()
    per_platform = rows.groupBy("platform").agg(
        n().alias("input_count"), n(kept).alias("row_count"), n(~kept).alias("excluded_count"),
        n(F.col("date_recovered")).alias("date_normalizations"),
    )
    total = per_platform.agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c)
        for c in ("input_count", "row_count", "excluded_count", "date_normalizations")
    ])
    return total.select(F.lit("(all)").alias("platform"), "*").unionByName(per_platform)


def prepare_reviews(raw: DataFrame, rules: dict | Rules | None = None) -> Prepared:
    """Check, then prepare. Fails on the first broken rule; nothing is coerced."""
    settings = rules if isinstance(rules, Rules) else Rules.of(rules)
    broken = violations(raw, settings).limit(10).collect()
    if broken:
        raise ValueError("input breaks the rules: " + ", ".join(f"{r.record_id}: {r.rule}" for r in broken))
    return Prepared(prepared_rows(raw, settings), excluded_rows(raw, settings), report(raw, settings))
