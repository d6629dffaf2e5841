"""ISO dates kept as text, and their UTC reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = r"^\d{4}-\d{2}-\d{2}$"
STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?$"
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def has_offset(value: Column) -> Column:
    return (F.length(value) > 10) & F.substring(value, 11, 40).rlike(OFFSET)


def parse_utc(value: Column) -> Column:
    """UTC wall-clock time of an ISO date or stamp; null for anything else.

    A day reads as midnight and a stamp without an offset as UTC.
    """
    full = (
        F.when(value.rlike(DAY), F.concat(value, F.lit("T00:00:00Z")))
        .when(value.rlike(STAMP) & has_offset(value), value)
        .when(value.rlike(STAMP), F.concat(value, F.lit("Z")))
    )
    local = F.try_to_timestamp(full).cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)


def iso_text(value: Column) -> Column:
    """The stamp as written by an ISO formatter: ``T``, colons in the offset, no ``Z``."""
    body = F.concat(F.substring(value, 1, 10), F.lit("T"), F.substring(value, 12, 60))
    body = F.regexp_replace(body, r"Z$", "+00:00")
    body = F.regexp_replace(body, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.regexp_replace(body, r"T(\d{2}:\d{2})(?=$|[+-])", "T$1:00")


def month(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")


def day(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")
