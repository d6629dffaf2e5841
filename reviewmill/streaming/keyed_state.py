"""Reconciliation with one state per review instead of reads of the store's history.

Every review of a provider keeps the content and the date of its newest accepted
row in Spark's own state store (RocksDB), so a micro-batch costs what its rows
cost, however long the history is.  The outcomes are those of
``operators.store.classify``.  Restarted from its checkpoint the stream goes on
where it was; started on a store that has reviews it takes their current state
as its initial state.

Per review and micro-batch one row comes out: how many rows had which outcome,
and the last accepted row, numbered by the review's own version.  Rows of one
review in one micro-batch are held as three numbers each; whole rows are held
only as long as no newer date is seen.  ``max_files`` of the source bounds a
micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .. import schemas as S
from ..functions.dates import parse_utc
from ..operators import store as R

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_DATE = np.iinfo(np.int64).min
STATE = "known boolean, content string, at bigint, version bigint"
KEYS = ["provider", "record_id"]
#: What a version takes over from its row.
PAYLOAD = ["app_id", "source_id", "country", "text", "title", "rating", "app_version", "updated_at", "fetched_at"]
OUTPUT = "provider string, record_id string, version bigint, inserted bigint, edited bigint, duplicates bigint, stale bigint, " \
    "app_id string, source_id string, country string, text string, title string, rating int, app_version string, " \
    "updated_at timestamp_ntz, fetched_at timestamp_ntz"


def outcomes(at: np.ndarray, content: np.ndarray, known: bool, stored_content: int, stored_at: int) -> tuple[np.ndarray, int]:
    """Outcome of every row of one review in order (as in ``S.OUTCOMES``), and the place of the last accepted row (or -1).

    ``content`` numbers equal contents alike; ``stored_content`` is -1 for content that no row has.
    """
    live = np.ones(len(at), bool)
    if known and stored_at == NO_DATE:
        # A stored review without a date takes in equal content until the first difference.
        differs = np.flatnonzero(content != stored_content)
        live[:differs[0] if len(differs) else len(at)] = False
    dated = at != NO_DATE
    newest = np.maximum.accumulate(np.concatenate(([stored_at], np.where(live, at, NO_DATE))))[:-1]
    stale = live & dated & (at < newest)
    standing = np.where(live & ~stale & (dated | (newest == NO_DATE)), np.arange(len(at)), -1)
    last = np.maximum.accumulate(np.concatenate(([-1], standing)))[:-1]
    before = np.where(last >= 0, content[np.maximum(last, 0)], stored_content)
    seen = known | (last >= 0)
    same = ~live | (live & ~stale & seen & (before == content) & dated & (at == newest))
    result = np.where(stale, 3, np.where(same, 2, np.where(seen, 1, 0)))
    accepted = np.flatnonzero(result < 2)
    return result, int(accepted[-1]) if len(accepted) else -1


class ReviewState(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("review", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.state.update((True, row["content"], int(row["at"]), 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, stored_content, stored_at, version = self.state.get() if self.state.exists() else (False, None, NO_DATE, 0)
        numbers: dict[str, int] = {}
        parts, held, newest = [], pd.DataFrame(), NO_DATE
        for rows_now in rows:
            codes = [numbers.setdefault(content, len(numbers)) for content in rows_now["content"]]
            at = rows_now["at"].to_numpy(np.int64)
            parts.append(np.stack([rows_now["fetched"].to_numpy(np.int64), rows_now["batch_order"].to_numpy(np.int64), at,
                                   np.array(codes, np.int64)]))
            # The last accepted row has the newest date of all, or none has a date.
            newest = max(newest, int(at.max()))
            held = pd.concat([held, rows_now.assign(code=codes)]) if len(held) else rows_now.assign(code=codes)
            held = held[held["at"].to_numpy() == newest]
        fetched, order, at, code = np.concatenate(parts, axis=1)
        by = np.lexsort((code, at, order, fetched))
        found, last = outcomes(at[by], code[by], known, numbers.get(stored_content, -1), stored_at)
        counts = np.bincount(found, minlength=4).tolist()
        row = {name: None for name in PAYLOAD}
        if last >= 0:
            spot = by[last]
            same = held[(held["fetched"] == fetched[spot]) & (held["batch_order"] == order[spot]) & (held["code"] == code[spot])]
            if len(same):
                row = {name: same.iloc[0][name] for name in PAYLOAD}
            content = next(name for name, number in numbers.items() if number == code[spot])
            version += 1
            self.state.update((True, content, max(int(at[spot]), stored_at), version))
        yield pd.DataFrame([{"provider": key[0], "record_id": key[1], "version": version if last >= 0 else None,
                             **dict(zip(S.OUTCOMES, counts)), **row}])

    def close(self) -> None:
        pass


def _micros(moment: Column) -> Column:
    return F.coalesce(F.unix_micros(F.to_utc_timestamp(moment.cast("timestamp"), F.current_timezone())), F.lit(NO_DATE))


def initial_state(state: DataFrame) -> DataFrame:
    """``provider, record_id, content, at`` of the store's current versions, a row per provider that fed them."""
    native = lambda field: F.try_element_at("native", F.concat("provider", F.lit(f"__{field}")))
    fed = state.select("record_id", "native", F.explode(F.array(*[F.lit(p) for p in S.STORE_PROVIDERS])).alias("provider")) \
        .where(native("source_id").isNotNull())
    return fed.select("provider", "record_id", R._fingerprint(native).alias("content"), _micros(parse_utc(native("updated_at"))).alias("at"))


def keyed_changes(stream: DataFrame, identities: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """One row per review and micro-batch for a stream of observations.

    ``identities`` are the provider ids known under another record when the stream starts; every other id is its own
    record.  ``state`` is the store's current state, for a stream that starts on a store with reviews.
    """
    rows = R.resolve(stream, identities).select(
        *KEYS, "batch_order", _micros(F.col("fetched_at")).alias("fetched"), _micros(F.col("updated_at")).alias("at"),
        R._fingerprint(F.col).alias("content"), *PAYLOAD)
    initial = initial_state(state).groupBy(*KEYS) if state is not None else None
    return rows.groupBy(*KEYS).transformWithStateInPandas(
        ReviewState(), OUTPUT, outputMode="Update", timeMode="None", initialState=initial)


def follow(changes: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the changes to a Parquet table, each exactly once; ``once`` works off what has landed and stops."""
    changes.sparkSession.conf.set(PROVIDER_KEY, ROCKSDB)

    def write(batch: DataFrame, batch_id: int) -> None:
        # A retried micro-batch writes its own folder again.
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def changes_at(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{OUTPUT}, batch bigint").parquet(path)


def latest(changes: DataFrame) -> DataFrame:
    """The newest accepted row of every review."""
    rows = changes.where(F.col("version").isNotNull())
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct("version", *PAYLOAD), "version").alias("v")).select(*KEYS, "v.*")
