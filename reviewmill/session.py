"""Session defaults and the shared folder for checkpoints and working tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES = 8 << 20


def build_session(master: str | None = None, name: str = "reviewmill", **conf) -> SparkSession:
    """A session with adaptive execution and a UTC clock; ``conf`` overrides the defaults."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a fresh local one only for a local master without it."""
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set(CHECKPOINT_KEY, folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder for one job's tables."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Plans made inside give their shuffle files back as soon as they ran; else those lie on disk until the driver collects garbage."""
    if spark.conf.get(CLEANUP_KEY, "false") == "true":
        yield
        return
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_KEY)


def stored(df: DataFrame, label: str = "step", codec: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back.

    For loops: unlike a checkpoint, the result carries no constraints over from
    the plan that made it, so planning stays as cheap in the last round as in
    the first, and its size is known.
    """
    path = work_path(df.sparkSession, label)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path, compression=codec)
    result = df.sparkSession.read.schema(df.schema).parquet(path)
    result._stored_at = path
    return result


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` once everything that reads them was written itself."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.__dict__["_stored_at"])
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what goes to and from Python workers at once by bytes, not only by rows: a row may be a very long text."""
    for key in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxBytesPerOutputBatch"):
        spark.conf.set(key, str(ARROW_BYTES))


def small_inputs(spark: SparkSession) -> None:
    """Bound only what goes to Python workers at once; Spark 4.1 fails to read large batches of lists it has to cut on their way back."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerOutputBatch")


def lookup(df: DataFrame) -> DataFrame:
    """Write a table that should be small, so that Spark knows its bytes and broadcasts it only below its own bound."""
    return stored(df, "lookup")
