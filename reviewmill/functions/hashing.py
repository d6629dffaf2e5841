"""Fingerprints of texts, records and ordered tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 4096
LEVELS = 4


def text_hash(text: Column) -> Column:
    """SHA-256 (hex) of the exact UTF-8 text."""
    return F.sha2(text, 256)


def canonical_json(columns: dict[str, Column]) -> Column:
    """JSON with sorted keys and nulls kept, so equal records give equal text."""
    ordered = [columns[name].alias(name) for name in sorted(columns)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def fingerprint(columns: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def row_digest(position: Column, cells: list[Column]) -> Column:
    """Digest of one row; position and cell lengths keep order and boundaries."""
    framed = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cells]
    return F.sha2(F.concat_ws("|", position.cast("string"), *framed), 256)


def ordered_digest(df: DataFrame, position: str, cells: list[str]) -> DataFrame:
    """One digest for a table read in ``position`` order.

    A tree with a fixed fan-out: a group never holds more than ``FANOUT`` child
    digests, and every level is a map-side combinable aggregate.
    """
    level = df.select(
        F.col(position).cast("bigint").alias("at"),
        row_digest(F.col(position), [F.col(c) for c in cells]).alias("digest"),
        F.lit(1).cast("bigint").alias("rows"),
    )
    for _ in range(LEVELS):
        children = F.array_sort(F.collect_list(F.struct("at", "digest")))
        level = level.groupBy(F.floor(F.col("at") / FANOUT).cast("bigint").alias("parent")).agg(
            F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ""), 256).alias("digest"),
            F.sum("rows").alias("rows"),
        ).withColumnRenamed("parent", "at")
    return level.select("rows", "digest")


def author_pseudonym(uri: Column, salt: bytes, version: str) -> Column:
    """Salted keyed hash of the numeric author id at the end of a profile link.

    HMAC-SHA-256 written with two built-in digests, so it stays in the JVM.
    """
    key = salt if len(salt) <= 64 else hashlib.sha256(salt).digest()
    block = key.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    number = F.regexp_extract(uri, r"/id(\d+)$", 1)
    first = F.unhex(F.sha2(F.concat(inner, F.encode(number, "UTF-8")), 256))
    keyed = F.sha2(F.concat(outer, first), 256)
    return F.when(number != "", F.concat(F.lit(version + ":"), keyed)).cast(T.StringType())
