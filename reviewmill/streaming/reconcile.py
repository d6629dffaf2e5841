"""Continuous reconciliation of landed observations into the versioned store.

A micro-batch becomes one revision of the store (``sources.bucket_store``), under
the name of its stream and its number.  A retried batch finds its revision and
changes nothing; several streams may write to one store.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..operators import store as R
from ..operators.ordered import numbered
from ..session import checkpointed, stored
from ..sources.bucket_store import Changes, Store, View
from ..sources.pages import page_observations, page_problems


def in_order(batch: DataFrame) -> DataFrame:
    """Number a batch's rows by fetch time, capture (where given) and order in the file; files may all count from 0."""
    fields = S.OBSERVATIONS.fieldNames()
    extra = [name for name in S.PROVENANCE if name in batch.columns]
    capture = [name for name in extra if name == "capture_ref"]
    rest = [name for name in fields if name not in ("fetched_at", "batch_order")]
    rows = batch.select(*fields, *extra).withColumnRenamed("batch_order", "in_file")
    return numbered(rows, ["fetched_at", *capture, "in_file", *rest], "batch_order").select(*fields, *extra)


def merged(batch: DataFrame, view: View, seq: int, operation: str, until: datetime | None = None) -> Changes:
    """What an ordered batch adds to the store; only buckets of its provider ids and records are read."""
    identities = view.identities_of(batch)
    resolved = stored(R.resolve(batch, identities), "resolved")
    state = stored(view.state_of(resolved), "touched-state")
    classified = stored(R.classify(resolved, identities, state), "classified")
    scope = F.concat_ws(":", "provider", "app_id", F.lower("country"))
    incoming = classified.groupBy(scope.alias("scope")).agg(
        (F.max("fetched_at") if until is None else F.lit(until).cast("timestamp_ntz")).alias("value")).withColumn("revision", F.lit(operation))
    counts = R.outcome_counts(classified).where(F.col("provider") == "(all)").first()
    return Changes(
        R.next_versions(classified, state, seq), R.new_identities(classified, identities),
        R.upsert_checkpoints(view.checkpoints(batch.sparkSession), incoming), {o: counts[o] for o in S.OUTCOMES})


def commit_rows(store: Store, batch: DataFrame, operation: str, until: datetime | None = None, parent: str | None = None) -> dict:
    """Apply observations as one revision and return its record.

    ``until`` is the end of the window the batch covers, else its sources are covered up to their last fetch.  An
    operation that is committed already is left alone if its rows are the same and refused if they are not; with
    ``parent`` the commit is refused unless that revision is still the newest.
    """
    batch = checkpointed(in_order(batch))
    found = R.observations_digest(batch).select("digest").first()
    digest = found["digest"] if found else "empty"
    return store.commit(batch.sparkSession, operation, digest, lambda view, seq: merged(batch, view, seq, operation, until), parent)


def commit_batch(store: Store, batch: DataFrame, batch_id: int, stream: str = "stream", until: datetime | None = None) -> dict:
    """Apply one micro-batch as one revision; stream and batch number are the operation."""
    return commit_rows(store, batch, f"{stream}-batch-{batch_id}", until)


def commit_pages(
    store: Store, feed: DataFrame, rpc: DataFrame, since: datetime, until: datetime, batch_id: int, stream: str = "pages"
) -> DataFrame:
    """From captured pages to a revision: parse, gate, window, quarantine, merge, checkpoint at the window's end.

    A malformed page fails its source, and a batch with a failed or missing source is refused.  Returns what was quarantined.
    """
    spark = feed.sparkSession
    problems = stored(page_problems(feed, rpc), "page-problems")
    failed = problems.select("provider").distinct().withColumn("status", F.lit("failed"))
    sources = spark.createDataFrame([(p,) for p in S.STORE_PROVIDERS], "provider string").join(failed, "provider", "left") \
        .select("provider", F.coalesce("status", F.lit("success")).alias("status"))
    if not R.batch_gate(sources).first()["may_commit"]:
        raise ValueError(f"pages are refused: {[tuple(row) for row in problems.limit(5).collect()]}")
    start, end = [F.lit(moment).cast("timestamp_ntz") for moment in (since, until)]
    rows = page_observations(feed, rpc).where(R.in_window(F.col("provider"), F.col("updated_at"), start, end))
    rows = stored(rows.withColumn("run_id", F.lit(f"{stream}-batch-{batch_id}")), "page-rows")
    bad = R.quarantine(rows)
    fine = rows.where(~((F.coalesce("source_id", F.lit("")) == "") | F.coalesce(~F.col("rating").between(1, 5), F.lit(False))))
    commit_batch(store, fine, batch_id, stream, until)
    return bad


def landed(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of observation files under a folder."""
    reader = spark.readStream.schema(S.OBSERVATIONS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def reconcile_stream(
    stream: DataFrame, store: Store, checkpoint: str, once: bool = True, name: str = "stream"
) -> StreamingQuery:
    """Start the job; ``once`` works off what has landed and stops.

    Every row reaches the merge, however late.  ``name`` tells streams on one store apart; a stream that starts
    over with a new ``checkpoint`` needs a new name.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: commit_batch(store, batch, batch_id, name))
    return (writer.trigger(availableNow=True) if once else writer).start()
