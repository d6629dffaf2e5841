"""The streaming job over the observation view, landed in three parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.hashing import text_hash
from ..session import checkpointed, work_path
from ..sources.pages import captured_pages
from ..sources.revisions import StaleParent
from ..sources.tables import observations, reviews, table
from ..streaming import keyed_state as K
from ..streaming import reconcile as St
from .intake import feed_pages, rpc_pages
from .raw_store import OUTCOMES, STATE_SQL, _halves, _identities, _state_columns
from .registry import query
from .views import OBSERVATIONS, REVIEWS, over

PARTS = 3
LATE = [0, 2, 1]
LATE_OUTCOMES = OUTCOMES.replace("SELECT event_id AS batch_order", f"""SELECT event_id + 1000000000 * CAST(list_position({LATE},
    CAST(floor(event_id * {PARTS} / (1.0 + (SELECT max(event_id) FROM events))) AS INT)) AS BIGINT) AS batch_order""", 1)
FINAL = f""",
final AS (SELECT record_id, arg_max(provider, batch_order) AS provider, arg_max(text, batch_order) AS text, arg_max(rating, batch_order) AS rating, max(updated_at) AS updated_at,
  arg_max(fetched_at, batch_order) AS collected_at, 0 AS seq FROM outcomes WHERE outcome IN ('inserted', 'edited') GROUP BY 1)
SELECT * EXCLUDE (seq) FROM ({STATE_SQL} FROM final)"""


def thirds(spark, sf, landing, order=tuple(range(PARTS))):
    """Land thirds of the observations in the given order; goes on after each."""
    last = table(spark, sf, "events").agg(F.max("event_id").alias("m")).scalar()
    rows = observations(spark, sf).withColumn("part", F.floor(F.col("batch_order") * PARTS / (last + 1)))
    for part in order:
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(landing)
        yield part


def run(spark, sf, order=tuple(range(PARTS))):
    """Land thirds of the observations in the given order and let the job work off each."""
    root = work_path(spark, "stream")
    store = St.Store(f"{root}/store")
    store.initialize(spark, _identities(spark, sf))
    for _ in thirds(spark, sf, f"{root}/landing", order):
        stream = St.landed(spark, f"{root}/landing")
        St.reconcile_stream(stream, store, f"{root}/progress").awaitTermination()
    return store


@query("stream_reconcile", over(OUTCOMES, FINAL))
def stream_reconcile(spark, sf):
    return _state_columns(run(spark, sf).state(spark)).drop("seq")


@query("stream_late", over(LATE_OUTCOMES, FINAL))
def stream_late(spark, sf):
    """The whole state after the middle third came last: late reviews get in, late edits of newer ones are stale."""
    return _state_columns(run(spark, sf, LATE).state(spark)).drop("seq")


@query("stream_keyed", over(LATE_OUTCOMES, """,
counts AS (SELECT record_id, provider, count(*) FILTER (WHERE outcome = 'inserted') AS inserted, count(*) FILTER (WHERE outcome = 'edited') AS edited,
  count(*) FILTER (WHERE outcome = 'duplicates') AS duplicates, count(*) FILTER (WHERE outcome = 'stale') AS stale FROM outcomes GROUP BY 1, 2),
final AS (SELECT record_id, provider, arg_max(text, batch_order) AS text, arg_max(rating, batch_order) AS rating, max(updated_at) AS updated_at
  FROM outcomes WHERE outcome IN ('inserted', 'edited') GROUP BY 1, 2)
SELECT record_id, provider, text, rating, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at, inserted, edited, duplicates, stale
FROM final JOIN counts USING (record_id, provider)"""))
def stream_keyed(spark, sf):
    """The late stream with a state per review: three starts from one checkpoint."""
    root = work_path(spark, "keyed")
    identities = _identities(spark, sf)
    for _ in thirds(spark, sf, f"{root}/landing", LATE):
        changes = K.keyed_changes(St.landed(spark, f"{root}/landing"), identities)
        K.follow(changes, f"{root}/changes", f"{root}/progress").awaitTermination()
    changes = K.changes_at(spark, f"{root}/changes")
    counts = changes.groupBy(*K.KEYS).agg(*[F.sum(o).alias(o) for o in S.OUTCOMES])
    return K.latest(changes).join(counts, K.KEYS).select(
        *K.KEYS, "text", "rating", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), *S.OUTCOMES)


@query("stream_checkpoint", over(OBSERVATIONS, """
SELECT provider || ':' || app_id || ':' || country AS scope, strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S') AS value FROM observations GROUP BY 1"""))
def stream_checkpoint(spark, sf):
    return run(spark, sf).checkpoints(spark).select("scope", F.date_format("value", "yyyy-MM-dd HH:mm:ss").alias("value"))


# The newer half is committed first, the older one after it.
SWAPPED_OUTCOMES = OUTCOMES.replace("SELECT event_id AS batch_order", """SELECT event_id + CASE WHEN ts <=
    (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) THEN 1000000000 ELSE 0 END AS batch_order""", 1)


@query("concurrent_commit", over(SWAPPED_OUTCOMES, FINAL))
def concurrent_commit(spark, sf):
    """Two writers on one revision: the one that is late reads again, merges again and loses nothing."""
    older, newer = _halves(spark, sf)
    store = St.Store(work_path(spark, "two-writers"))
    store.initialize(spark, _identities(spark, sf))
    batch = checkpointed(St.in_order(older))
    raced = []

    def merge(view, seq):
        if not raced:
            # The other writer commits between this one's look at the store and its own commit.
            raced.append(St.commit_rows(store, newer, "newer"))
        return St.merged(batch, view, seq, "older")

    record = store.commit(spark, "older", "older half", merge)
    assert (raced[0]["seq"], record["seq"], record["parent"]) == (2, 3, raced[0]["id"])
    return _state_columns(store.state(spark)).drop("seq")


@query("operation_replay", over(OUTCOMES, f""",
c AS (SELECT CAST(seq AS BIGINT) AS seq, {", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in S.OUTCOMES)}
  FROM outcomes WHERE seq = 3 GROUP BY seq)
SELECT 'repeat' AS attempt, 'committed' AS verdict, * FROM c UNION ALL SELECT 'repeat without parent', 'committed', * FROM c
UNION ALL SELECT 'other rows', 'refused', 0, 0, 0, 0, 0 UNION ALL SELECT 'other parent', 'refused', 0, 0, 0, 0, 0
UNION ALL SELECT 'old parent', 'stale parent', 0, 0, 0, 0, 0 UNION ALL SELECT 'next', 'committed', 4, 0, 0, 0, 0"""))
def operation_replay(spark, sf):
    """Commits of the halves through the store, then what repeated, altered and late attempts get."""
    older, newer = _halves(spark, sf)
    store = St.Store(work_path(spark, "replay"))
    store.initialize(spark, _identities(spark, sf))
    first = St.commit_rows(store, older, "first")
    second = St.commit_rows(store, newer, "second", parent=first["id"])
    attempts = {
        "repeat": (newer, "second", first["id"]), "repeat without parent": (newer, "second", None),
        "other rows": (older, "second", first["id"]), "other parent": (newer, "second", second["id"]),
        "old parent": (newer, "third", first["id"]), "next": (newer.limit(0), "third", second["id"]),
    }
    rows = []
    for attempt, (batch, operation, parent) in attempts.items():
        try:
            record = St.commit_rows(store, batch, operation, parent=parent)
            rows.append((attempt, "committed", record["seq"], *[record[o] for o in S.OUTCOMES]))
        except ValueError:
            rows.append((attempt, "refused", *[0] * 5))
        except StaleParent:
            rows.append((attempt, "stale parent", *[0] * 5))
    return spark.createDataFrame(rows, "attempt string, verdict string, seq bigint, " + ", ".join(f"{o} bigint" for o in S.OUTCOMES))


PAGES_SQL = over(REVIEWS, """,
span AS (SELECT min(record_ts) AS low, max(record_ts) AS high FROM reviews),
kept AS (SELECT r.* FROM reviews r, span WHERE (platform = 'app_store' AND record_ts <= high)
  OR (platform = 'google_play' AND record_ts BETWEEN low + (high - low) / 2 AND high))
SELECT CASE platform WHEN 'app_store' THEN 'apple_rss' ELSE 'play' END || ':app:' || record_id AS record_id, platform, 'MX' AS country,
  sha256(text) AS text_hash, rating, strftime(record_ts, '%Y-%m-%d %H:%M:%S') AS updated_at, '2030-01-01 00:00:00' AS collected_at,
  strftime(high, '%Y-%m-%d %H:%M:%S') AS covered_until FROM kept, span""")


@query("pages_to_store", PAGES_SQL)
def pages_to_store(spark, sf):
    """Captured page files, landed and committed as a revision; the last source's checkpoint is the window's end."""
    root = work_path(spark, "pages")
    for name, pages in (("feed", feed_pages(spark, sf)), ("rpc", rpc_pages(spark, sf))):
        folder = f"{root}/{name}/app_id=app/country=mx/fetched_at=20300101T000000"
        pages.repartition("page").write.partitionBy("page").text(folder)
    feed, rpc = [captured_pages(spark, f"{root}/{name}") for name in ("feed", "rpc")]
    span = reviews(spark, sf, "dates").agg(F.min("record_ts").alias("low"), F.max("record_ts").alias("high")).first()
    store = St.Store(f"{root}/store")
    store.initialize(spark)
    St.commit_pages(store, feed, rpc, span["low"] + (span["high"] - span["low"]) / 2, span["high"], 0)
    covered = store.checkpoints(spark).agg(F.min("value").alias("v")).scalar()
    stamp = "yyyy-MM-dd HH:mm:ss"
    return store.at(spark, "pages-batch-0").select(
        "record_id", "platform", "country", text_hash(F.col("text")).alias("text_hash"), "rating",
        F.date_format("updated_at", stamp).alias("updated_at"), F.date_format("collected_at", stamp).alias("collected_at"),
        F.date_format(covered, stamp).alias("covered_until"))
