"""Reconciliation of the observation view: history first, then the newer half as one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.numbers import n
from ..operators import store as R
from ..session import checkpointed
from ..sources.tables import observations, reviews, table
from .registry import query
from .views import OBSERVATIONS, REVIEWS, over

# Every accepted observation is newer than or equal to the one before it, so the
# expected outcome of the whole stream follows from running windows.
OUTCOMES = OBSERVATIONS + """,
span AS (SELECT min(fetched_at) + (max(fetched_at) - min(fetched_at)) / 2 AS middle FROM observations),
known AS (SELECT DISTINCT provider, app_id, source_id, 'hist:' || source_id AS record_id FROM observations WHERE rating <= 2),
keyed AS (
  SELECT o.*, coalesce(k.record_id, o.provider || ':' || o.app_id || ':' || o.source_id) AS record_id,
    max(updated_at) OVER (PARTITION BY o.provider, o.app_id, o.source_id ORDER BY batch_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bar
  FROM observations o LEFT JOIN known k ON k.provider = o.provider AND k.app_id = o.app_id AND k.source_id = o.source_id),
fresh AS (
  SELECT *, lag(text) OVER w AS last_text, lag(updated_at) OVER w AS last_at, row_number() OVER w AS turn
  FROM keyed WHERE bar IS NULL OR updated_at >= bar WINDOW w AS (PARTITION BY provider, app_id, source_id ORDER BY batch_order)),
outcomes AS (
  SELECT k.*, CASE WHEN f.batch_order IS NULL THEN 'stale' WHEN f.turn = 1 THEN 'inserted'
    WHEN f.last_text = f.text AND f.last_at = f.updated_at THEN 'duplicates' ELSE 'edited' END AS outcome,
    CASE WHEN k.fetched_at <= middle THEN 2 ELSE 3 END AS seq
  FROM span, keyed k LEFT JOIN fresh f ON f.batch_order = k.batch_order),
versions AS (
  SELECT record_id, seq, arg_max(provider, batch_order) AS provider, arg_max(text, batch_order) AS text, arg_max(rating, batch_order) AS rating,
    max(updated_at) AS updated_at, arg_max(fetched_at, batch_order) AS collected_at
  FROM outcomes WHERE outcome IN ('inserted', 'edited') GROUP BY record_id, seq)"""


def _identities(spark, sf):
    """Records that were known under another id before."""
    return observations(spark, sf).where(F.col("rating") <= 2).select(
        *S.OBSERVATION_KEY, F.concat(F.lit("hist:"), F.col("source_id")).alias("record_id")
    ).distinct()


def _halves(spark, sf):
    seen = observations(spark, sf)
    span = table(spark, sf, "events").agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("middle")).scalar()
    return seen.where(F.col("fetched_at") <= span), seen.where(F.col("fetched_at") > span)


def _history(spark, sf):
    old, new = _halves(spark, sf)
    identities = _identities(spark, sf)
    nothing = R.empty_state(spark)
    # The history is a committed revision: pin it, as the store's table would.
    first = checkpointed(R.next_versions(R.classify(old, identities, nothing), nothing, 2))
    batch = R.classify(new, identities, first)
    return first, batch


def _versions(spark, sf):
    first, batch = _history(spark, sf)
    return first.unionByName(R.next_versions(batch, first, 3))


@query("reconcile_counts", over(OUTCOMES, """,
c AS (SELECT provider, """ + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in S.OUTCOMES) + """ FROM outcomes WHERE seq = 3 GROUP BY provider)
SELECT * FROM c UNION ALL SELECT '(all)', """ + ", ".join(f"CAST(sum({o}) AS BIGINT)" for o in S.OUTCOMES) + " FROM c"))
def reconcile_counts(spark, sf):
    return R.outcome_counts(_history(spark, sf)[1])


STATE_SQL = """
SELECT record_id, CASE provider WHEN 'play' THEN 'google_play' ELSE 'app_store' END AS platform, provider AS preferred_provider, 'MX' AS country,
  text, rating, strftime(updated_at, '%Y-%m-%d') AS updated_at, strftime(collected_at, '%Y-%m-%d %H:%M:%S') AS collected_at, CAST(seq AS BIGINT) AS seq"""


def _state_columns(df):
    return df.select(
        "record_id", "platform", "preferred_provider", "country", "text", "rating",
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated_at"),
        F.date_format("collected_at", "yyyy-MM-dd HH:mm:ss").alias("collected_at"), "seq",
    )


@query("reconcile_state", over(OUTCOMES, f"{STATE_SQL} FROM versions"))
def reconcile_state(spark, sf):
    return _state_columns(_versions(spark, sf))


@query("raw_asof", over(OUTCOMES, f"{STATE_SQL} FROM (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq DESC) = 1)"))
def raw_asof(spark, sf):
    return _state_columns(R.as_of(_versions(spark, sf)))


@query("raw_asof_first", over(OUTCOMES, f"{STATE_SQL} FROM versions WHERE seq <= 2"))
def raw_asof_first(spark, sf):
    return _state_columns(R.as_of(_versions(spark, sf), 2))


@query("revision_diff", over(OUTCOMES, """
SELECT record_id, count(*) AS versions, CAST(min(seq) AS BIGINT) AS first_seq, CAST(max(seq) AS BIGINT) AS last_seq,
  CASE WHEN min(seq) > 2 THEN 'added' ELSE 'changed' END AS change FROM versions GROUP BY record_id HAVING max(seq) > 2"""))
def revision_diff(spark, sf):
    return R.revision_diff(_versions(spark, sf), 2, 3)


@query("revision_sizes", over(OUTCOMES, "SELECT CAST(seq AS BIGINT) AS seq, count(*) AS rows FROM versions GROUP BY seq"))
def revision_sizes(spark, sf):
    return R.revision_sizes(_versions(spark, sf))


@query("new_identities", over(OUTCOMES, """
SELECT DISTINCT o.provider, o.app_id, o.source_id, o.record_id FROM outcomes o
WHERE o.seq = 2 AND o.outcome IN ('inserted', 'edited') AND NOT EXISTS (
  SELECT 1 FROM known k WHERE k.provider = o.provider AND k.app_id = o.app_id AND k.source_id = o.source_id)"""))
def new_identities(spark, sf):
    old, _ = _halves(spark, sf)
    identities = _identities(spark, sf)
    return R.new_identities(R.classify(old, identities, R.empty_state(spark)), identities)


@query("seed_identities", over(REVIEWS, """
SELECT 'play' AS provider, coalesce(title, app_id) AS app_id, record_id AS source_id, record_id FROM reviews WHERE platform = 'google_play'
UNION ALL SELECT 'apple_rss', app_id, record_id, record_id FROM reviews WHERE platform = 'app_store'"""))
def seed_identities(spark, sf):
    is_play, is_apple = F.col("platform") == "google_play", F.col("platform") == "app_store"
    seed = reviews(spark, sf).select(
        "record_id", "app_id",
        F.when(is_play, F.col("record_id")).alias("play__source_id"), F.when(is_play, F.col("title")).alias("play__target"),
        F.when(is_apple, F.col("record_id")).alias("apple_rss__source_id"), F.lit(None).cast("string").alias("apple_rss__target"),
    )
    return R.seed_identities(seed)


def _day_sources(spark, sf):
    """One source report per provider and day: a day with many errors counts as failed."""
    return observations(spark, sf).groupBy("provider", F.date_format("fetched_at", "yyyy-MM-dd").alias("day")).agg(
        F.when(n(F.col("text") == "error") * 4 > n(), "failed").otherwise("success").alias("status")
    )


@query("batch_gate", over(OBSERVATIONS, """,
s AS (SELECT provider, strftime(fetched_at, '%Y-%m-%d') AS day, CASE WHEN 4 * count(*) FILTER (WHERE text = 'error') > count(*) THEN 'failed' ELSE 'success' END AS status
  FROM observations GROUP BY ALL)
SELECT count(*) FILTER (WHERE status = 'success') AS successful, count(*) FILTER (WHERE status <> 'success') AS failed,
  bool_or(provider = 'apple_rss') AS has_apple_rss, bool_or(provider = 'play') AS has_play, 0::BIGINT AS foreign,
  count(*) FILTER (WHERE status <> 'success') = 0 AND bool_or(provider = 'apple_rss') AND bool_or(provider = 'play') AS may_commit FROM s"""))
def batch_gate(spark, sf):
    return R.batch_gate(_day_sources(spark, sf))


@query("checkpoint_upsert", over(OBSERVATIONS, """,
d AS (SELECT provider || ':' || app_id || ':' || country AS scope, strftime(fetched_at, '%Y-%m-%d') AS day, max(updated_at) AS value FROM observations GROUP BY ALL)
SELECT scope, strftime(max(value), '%Y-%m-%d') AS value, arg_max(day, struct_pack(value := value, day := day)) AS revision FROM d GROUP BY scope"""))
def checkpoint_upsert(spark, sf):
    scope = F.concat_ws(":", "provider", "app_id", "country")
    daily = observations(spark, sf).groupBy(scope.alias("scope"), F.date_format("fetched_at", "yyyy-MM-dd").alias("revision")).agg(
        F.max("updated_at").alias("value")
    )
    days = F.date_format(F.col("value"), "yyyy-MM-dd")
    # The last day is the incoming batch; the days before it are what is stored.
    latest = daily.agg(F.max("revision").alias("r")).scalar()
    stored = daily.where(F.col("revision") < latest).groupBy("scope").agg(
        F.max("value").alias("value"), F.max_by("revision", F.struct("value", "revision")).alias("revision")
    )
    return R.upsert_checkpoints(stored, daily.where(F.col("revision") == latest).select("scope", "value", "revision")).select(
        "scope", days.alias("value"), "revision"
    )


@query("incremental_boundary", over(OBSERVATIONS, """
SELECT provider, app_id, country, strftime(max(updated_at) - INTERVAL 7 DAY, '%Y-%m-%d') AS since, 'overlap' AS basis FROM observations GROUP BY ALL"""))
def incremental_boundary(spark, sf):
    even = F.col("batch_order") % 2 == 0
    rows = observations(spark, sf).select(
        "provider", F.col("app_id").alias("target"), "updated_at",
        F.when(even, F.lit('{"country": " MX ", "lang": "es"}')).alias("locale"), F.upper("country").alias("country"),
    )
    sources = observations(spark, sf).select("provider", "app_id", "country").distinct()
    checkpoints = spark.createDataFrame([], "scope string, value timestamp_ntz")
    return R.incremental_boundary(rows, sources, checkpoints, 7).withColumn("since", F.date_format("since", "yyyy-MM-dd"))


PAGE = 100


def _pages(spark, sf):
    """Newest first, a fixed number of fetched rows per page."""
    newest = table(spark, sf, "events").agg(F.max("event_id").alias("m")).scalar()
    return observations(spark, sf).withColumn("page", F.floor((newest - F.col("batch_order")) / PAGE).cast("bigint"))


def _since(spark, sf):
    return table(spark, sf, "events").agg((F.max("ts") - F.expr("INTERVAL 2 DAYS")).alias("s")).scalar()


def _until(spark, sf):
    return table(spark, sf, "events").agg(F.max("ts").alias("u")).scalar()


PAGES = OBSERVATIONS + f""",
bounds AS (SELECT max(ts) - INTERVAL 2 DAY AS since, max(ts) AS until, max(event_id) AS newest FROM events),
pages AS (
  SELECT provider, CAST(floor((newest - batch_order) / {PAGE}) AS BIGINT) AS page, count(*) AS rows,
    count(*) FILTER (WHERE updated_at <= until AND (provider = 'apple_rss' OR updated_at >= since)) AS kept,
    min(updated_at) AS oldest, max(updated_at) AS newest, provider = 'play' AND max(updated_at) < any_value(since) AS stops_here
  FROM observations, bounds GROUP BY provider, 2)"""


@query("page_coverage", over(PAGES, """
SELECT provider, page, rows, kept, strftime(oldest, '%Y-%m-%d') AS oldest, strftime(newest, '%Y-%m-%d') AS newest, stops_here FROM pages"""))
def page_coverage(spark, sf):
    pages = R.page_coverage(_pages(spark, sf), _since(spark, sf), _until(spark, sf))
    return pages.withColumn("oldest", F.date_format("oldest", "yyyy-MM-dd")).withColumn("newest", F.date_format("newest", "yyyy-MM-dd"))


@query("source_coverage", over(PAGES, """
SELECT provider, CAST(sum(rows) AS BIGINT) AS rows, strftime(min(oldest), '%Y-%m-%d') AS oldest, min(page) FILTER (WHERE stops_here) AS last_page,
  provider = 'apple_rss' AND min(oldest) > (SELECT since FROM bounds) AS has_gap FROM pages GROUP BY provider"""))
def source_coverage(spark, sf):
    pages = R.page_coverage(_pages(spark, sf), _since(spark, sf), _until(spark, sf))
    return R.source_coverage(pages, _since(spark, sf)).withColumn("oldest", F.date_format("oldest", "yyyy-MM-dd"))


@query("observation_quarantine", """
SELECT CASE WHEN user_id % 2 = 0 THEN 'play' ELSE 'apple_rss' END AS provider, event_id AS batch_order,
  CASE WHEN event_type = 'error' THEN 'missing_source_id' ELSE 'invalid_rating' END AS rule
FROM events WHERE event_type = 'error' OR CAST(floor(value) AS INT) > 5 OR CAST(floor(value) AS INT) < 1
UNION ALL SELECT CASE WHEN user_id % 2 = 0 THEN 'play' ELSE 'apple_rss' END, NULL, 'over_item_limit' FROM events GROUP BY 1 HAVING count(*) > 1000""")
def observation_quarantine(spark, sf):
    rows = observations(spark, sf).drop("rating").join(
        table(spark, sf, "events").select(F.col("event_id").alias("batch_order"), F.floor("value").cast("int").alias("rating")), "batch_order"
    ).withColumn("source_id", F.when(F.col("text") != "error", F.col("source_id")))
    return R.quarantine(rows, 1000)
