"""Releases: a Parquet table with a manifest, their checks, a catalogue, an inventory."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import n


def content_digest(df: DataFrame) -> Column:
    """Order-free digest of all rows and columns, as one map-side combinable aggregate.

    Rows are keyed by a unique id, so their order carries no content; the sum of
    the four quarters of every row's SHA-256 identifies the set of rows.
    """
    fields = [F.coalesce(F.to_json(F.array(F.col(c).cast("string"))), F.lit("null")) for c in df.columns]
    row = F.sha2(F.concat_ws(",", *fields), 256)
    quarters = [
        F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)
    ]
    return F.sha2(F.concat_ws("|", n().cast("string"), *[F.coalesce(q, F.lit("0")) for q in quarters]), 256)


def column_list(df: DataFrame) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path: name, size, time; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), "modificationTime")


def _data_files(spark: SparkSession, path: str) -> DataFrame:
    return listing(spark, path).where(F.col("path").endswith(".parquet"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of every data file; one task reads one file at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("path").endswith(".parquet")).select(
        F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def file_problems(spark: SparkSession, path: str) -> DataFrame:
    """Files of a release that are missing, were changed or were added since its manifest was written."""
    declared = spark.read.schema("name string, bytes bigint, sha256 string").json(f"{path}/files").alias("d")
    observed = file_hashes(spark, f"{path}/data").alias("o")
    problem = F.when(F.col("o.name").isNull(), "missing").when(F.col("d.name").isNull(), "added").when(
        F.col("d.sha256") != F.col("o.sha256"), "changed")
    both = declared.join(observed, F.col("d.name") == F.col("o.name"), "full_outer")
    return both.select(F.coalesce("d.name", "o.name").alias("name"), problem.alias("problem")).where("problem is not null")


def write_release(df: DataFrame, path: str, key: str = "record_id", lineage: dict[str, str] | None = None) -> DataFrame:
    """Write rows in key order, then the manifest; an existing release is never touched."""
    spark = df.sparkSession
    data = f"{path}/data"
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(data)
    written = spark.read.schema(df.schema).parquet(data)
    sizes = _data_files(spark, data).agg(F.sum("bytes").alias("b"), n().alias("f"))
    manifest = written.agg(n().alias("row_count"), content_digest(written).alias("content_sha256")).select(
        F.lit(1).alias("format_version"),
        F.lit(str(uuid.uuid4())).alias("release_id"),
        "row_count", "content_sha256",
        sizes.select("b").scalar().alias("size_bytes"), sizes.select("f").scalar().alias("files"),
        F.lit(column_list(df)).alias("columns"),
        *[F.lit(v).alias(k) for k, v in (lineage or {}).items()],
    )
    file_hashes(spark, data).write.mode("errorifexists").json(f"{path}/files")
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/manifest")


def verify_release(spark: SparkSession, path: str) -> DataFrame:
    """Compare files by their hashes, columns, row count and content with the manifest."""
    data = spark.read.parquet(f"{path}/data")
    seen = data.agg(n().alias("rows"), content_digest(data).alias("digest"))
    size = _data_files(spark, f"{path}/data").agg(F.sum("bytes").alias("b")).scalar()
    manifest = read_manifest(spark, path)
    broken = file_problems(spark, path).agg(n().alias("broken")).scalar()
    rows, digest = seen.select("rows").scalar(), seen.select("digest").scalar()
    checks = manifest.select(
        (F.col("size_bytes") == size).alias("size_ok"), (broken == 0).alias("files_ok"),
        (F.col("columns") == F.lit(column_list(data))).alias("columns_ok"),
        (F.col("row_count") == rows).alias("rows_ok"),
        (F.col("content_sha256") == digest).alias("content_ok"),
        "row_count",
    )
    return checks.withColumn("valid", F.col("size_ok") & F.col("files_ok") & F.col("columns_ok") & F.col("rows_ok") & F.col("content_ok"))


# -- catalogue -------------------------------------------------------------

def publish(catalogue: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to append and conflicting rows; publishing the same run again adds nothing.

    Both tables carry ``seq, run_id, artifact_id, info``.  Inside one batch a run is published once, by its first row;
    rows of that run with another info are conflicts with it.
    """
    known = catalogue.select("run_id", F.col("info").alias("known_info"))
    first = incoming.groupBy("run_id").agg(F.min_by(F.struct(*catalogue.columns), F.struct("seq", "info")).alias("first"))
    fresh = first.join(known, "run_id", "left_anti").select("first.*")
    standing = first.join(known, "run_id", "left").select("run_id", F.coalesce("known_info", "first.info").alias("known_info"))
    conflicts = incoming.join(standing, "run_id").where(F.col("known_info") != F.col("info"))
    return fresh.select(*catalogue.columns), conflicts.select("run_id", "info", "known_info")


def resolve(catalogue: DataFrame, version: str = "latest") -> DataFrame:
    """The latest publication, or the one of an artifact."""
    rows = catalogue if version == "latest" else catalogue.where(F.col("artifact_id") == version)
    return rows.agg(F.max_by(F.struct(*catalogue.columns), "seq").alias("p")).where(F.col("p").isNotNull()).select("p.*")


# -- inventory -------------------------------------------------------------

def scope_sizes(files: DataFrame, root: str) -> DataFrame:
    """Files and bytes per first folder under a root."""
    relative = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", "")
    return files.groupBy(F.substring_index(relative, "/", 1).alias("scope")).agg(
        n().alias("objects"), F.sum("bytes").alias("bytes")
    )


def reconcile_files(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Declared against observed files: present, size equal, or not declared at all."""
    both = declared.select("name", F.col("bytes").alias("declared_bytes")).join(
        observed.select("name", F.col("bytes").alias("observed_bytes")), "name", "full_outer"
    )
    issue = F.when(F.col("observed_bytes").isNull(), "incomplete").when(
        F.col("declared_bytes").isNotNull() & (F.col("declared_bytes") != F.col("observed_bytes")), "invalid"
    ).when(F.col("declared_bytes").isNull(), "undeclared")
    return both.withColumn("issue", issue)


def release_status(reconciled: DataFrame) -> DataFrame:
    """``invalid`` beats ``incomplete``; otherwise the metadata is consistent."""
    return reconciled.agg(
        n(F.col("declared_bytes").isNotNull()).alias("declared"),
        F.when(n(F.col("issue") == "invalid") > 0, "invalid")
        .when(n(F.col("issue") == "incomplete") > 0, "incomplete")
        .otherwise("metadata_consistent").alias("status"),
    )
