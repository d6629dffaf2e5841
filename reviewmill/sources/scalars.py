"""Columns that mix scalar types, as tagged JSON text and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags of the text form.
TAGS = ["null", "pd.NA", "bool", "str", "int", "float"]
SPECIAL_FLOATS = {"NaN": "nan", "Infinity": "inf", "-Infinity": "-inf"}


def encode_scalar(tag: Column, value: Column) -> Column:
    """``["tag",value]``; floats that JSON cannot write become text."""
    special = F.create_map(*[F.lit(x) for pair in SPECIAL_FLOATS.items() for x in pair])
    quoted = F.to_json(F.array(value))
    literal = (
        F.when(tag.isin("null", "pd.NA"), "null")
        .when(tag == "str", F.substring(quoted, F.lit(2), F.length(quoted) - 2))
        .when((tag == "float") & F.map_contains_key(special, F.coalesce(value, F.lit(""))),
              F.concat(F.lit('"'), F.try_element_at(special, value), F.lit('"')))
        .otherwise(value)
    )
    return F.concat(F.lit('["'), tag, F.lit('",'), literal, F.lit("]"))


def decode_scalar(text: Column) -> Column:
    """``struct(tag, value)``; an unknown tag or a value of another type fails the job."""
    parts = F.from_json(text, "array<string>")
    tag, value = parts[0], parts[1]
    special = F.create_map(*[F.lit(x) for k, v in SPECIAL_FLOATS.items() for x in (v, k)])
    body = F.coalesce(F.try_element_at(special, value), value)
    valid = (
        F.when(tag.isin("null", "pd.NA"), value.isNull())
        .when(tag == "bool", value.isin("true", "false"))
        .when(tag == "str", value.isNotNull())
        .when(tag == "int", value.rlike(r"^-?\d+$"))
        .when(tag == "float", value.try_cast("double").isNotNull())
    )
    decoded = F.struct(tag.alias("tag"), F.when(tag == "float", body).otherwise(value).alias("value"))
    return F.when(F.coalesce(valid & (F.size(parts) == 2), F.lit(False)), decoded).otherwise(
        F.raise_error(F.concat(F.lit("invalid encoded scalar: "), F.coalesce(text, F.lit("null"))))
    )


def encode_columns(df, tags: dict[str, str]):
    """Encode the listed value columns, each with the column that holds its tag."""
    return df.withColumns({value: encode_scalar(F.col(tag), F.col(value)) for value, tag in tags.items()})
