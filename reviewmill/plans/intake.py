"""Captured pages, author names, mixed columns, label files and releases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashing import author_pseudonym, text_hash
from ..functions.numbers import n
from ..operators import features as Fe
from ..operators.prepare import prepared_rows
from ..session import work_path
from ..sources import release as L
from ..sources.labels import read_labels
from ..sources.pages import continuation, parse_feed_pages, parse_rpc_pages
from ..sources.scalars import decode_scalar, encode_scalar
from ..sources.tables import raw_reviews, reviews, table
from .registry import query
from .views import PREPARED, REVIEWS, over

SALT, SALT_VERSION = b"review authors", "v1"
_block = SALT.ljust(64, b"\0")
_inner = "".join(f"\\x{b ^ 0x36:02X}" for b in _block)
_outer = "".join(f"\\x{b ^ 0x5C:02X}" for b in _block)
PSEUDONYM = (
    f"'v1:' || sha256('{_outer}'::BLOB || unhex(sha256('{_inner}'::BLOB || encode(%s))))"
)
PAGE_ROWS = 50


def _numbered(spark, sf, platform):
    """Reviews of one store with the page each falls on; four platforms alternate by row."""
    rows = reviews(spark, sf, "dates").where(F.col("platform") == platform)
    return rows.withColumn("page", F.floor(F.col("source_row") / (4 * PAGE_ROWS)))


def feed_pages(spark, sf):
    """Feed pages written from the store's reviews; odd pages also carry app metadata."""
    label = lambda c: F.struct(c.cast("string").alias("label"))
    entry = F.struct(
        label(F.col("record_id")).alias("id"),
        label(F.date_format("record_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updated"),
        label(F.col("text")).alias("content"), label(F.col("title")).alias("title"),
        label(F.col("rating")).alias("im:rating"), label(F.lit("1.0")).alias("im:version"),
        F.struct(F.struct(F.concat(F.lit("https://example.com/reviews/id"), F.col("record_id")).alias("label")).alias("uri")).alias("author"),
    )
    entries = _numbered(spark, sf, "app_store").groupBy("page").agg(F.collect_list(F.to_json(entry)).alias("e"))
    metadata = F.when(F.col("page") % 2 == 1, F.array(F.lit('{"im:name":{"label":"App"}}'))).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.concat(metadata, "e"), ",")
    lone = (F.size("e") == 1) & (F.col("page") % 2 == 0)
    return entries.select(
        "page", F.concat(F.lit('{"feed":{"entry":'), F.when(lone, body).otherwise(F.concat(F.lit("["), body, F.lit("]"))), F.lit("}}")).alias("body")
    )


@query("parse_feed_pages", over(REVIEWS, f"""
SELECT record_id AS source_id, strftime(record_ts, '%Y-%m-%d %H:%M:%S') AS updated_at, sha256(text) AS text_hash, title, rating,
  '1.0' AS app_version, {PSEUDONYM % 'record_id'} AS author_hash FROM reviews WHERE platform = 'app_store'"""))
def parse_feed(spark, sf):
    parsed = parse_feed_pages(feed_pages(spark, sf), SALT, SALT_VERSION)
    return parsed.select("source_id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
                         text_hash(F.col("text")).alias("text_hash"), "title", "rating", "app_version", "author_hash")


def rpc_pages(spark, sf):
    """Framed responses written from the other store's reviews."""
    text = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    item = F.concat(
        F.lit("["), text(F.col("record_id")), F.lit(',["author"],'), F.col("rating").cast("string"), F.lit(",null,"), text(F.col("text")),
        F.lit(",["), F.unix_seconds(F.col("record_ts").cast("timestamp")).cast("string"), F.lit('],0,null,null,null,"1.0"]'),
    )
    items = _numbered(spark, sf, "google_play").groupBy("page").agg(F.array_join(F.collect_list(item), ",").alias("items"))
    payload = F.concat(F.lit("[["), F.col("items"), F.lit('],[null,"t'), F.col("page").cast("string"), F.lit('"],null]'))
    quoted = text(payload)
    return items.select("page", F.concat(F.lit(")]}'\n\n[[\"wrb.fr\",\"oCPfdb\","), quoted, F.lit("]]")).alias("body"))


@query("parse_rpc_pages", over(REVIEWS, """
SELECT record_id AS source_id, strftime(record_ts, '%Y-%m-%d %H:%M:%S') AS updated_at, sha256(text) AS text_hash, rating, '1.0' AS app_version
FROM reviews WHERE platform = 'google_play'"""))
def parse_rpc(spark, sf):
    return parse_rpc_pages(rpc_pages(spark, sf)).select(
        "source_id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
        text_hash(F.col("text")).alias("text_hash"), "rating", "app_version")


@query("page_tokens", over(REVIEWS, f"""
SELECT DISTINCT CAST(floor(source_row / {4.0 * PAGE_ROWS}) AS BIGINT) AS page, 't' || CAST(floor(source_row / {4.0 * PAGE_ROWS}) AS BIGINT) AS token
FROM reviews WHERE platform = 'google_play'"""))
def page_tokens(spark, sf):
    return continuation(rpc_pages(spark, sf))


@query("author_pseudonym", f"""
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE {PSEUDONYM % 'CAST(user_id AS VARCHAR)'} END AS author_hash FROM events""")
def author(spark, sf):
    link = F.concat(F.lit("https://example.com/reviews/id"), F.col("user_id").cast("string"), F.when(F.col("event_type") == "error", "?x").otherwise(""))
    return table(spark, sf, "events").select("event_id", author_pseudonym(link, SALT, SALT_VERSION).alias("author_hash"))


@query("mixed_scalar_roundtrip", """
SELECT tag, count(*) AS rows, 0::BIGINT AS changed FROM (
  SELECT CASE event_id % 7 WHEN 0 THEN 'null' WHEN 1 THEN 'pd.NA' WHEN 2 THEN 'bool' WHEN 3 THEN 'str' WHEN 4 THEN 'int' ELSE 'float' END AS tag FROM events) GROUP BY tag""")
def mixed_scalars(spark, sf):
    kind = F.col("event_id") % 7
    tag = F.when(kind == 0, "null").when(kind == 1, "pd.NA").when(kind == 2, "bool").when(kind == 3, "str").when(kind == 4, "int").otherwise("float")
    value = (
        F.when(kind == 2, (F.col("value") > 10).cast("string")).when(kind == 3, F.concat("event_type", F.lit('/"\n'), "props"))
        .when(kind == 4, F.col("user_id").cast("string"))
        .when(kind == 5, F.col("value").cast("string"))
        .when(kind == 6, F.element_at(F.array(F.lit("NaN"), F.lit("Infinity"), F.lit("-Infinity")), (F.col("user_id") % 3 + 1).cast("int")))
    )
    rows = table(spark, sf, "events").select(tag.alias("tag"), value.alias("value"))
    back = rows.withColumn("back", decode_scalar(encode_scalar(F.col("tag"), F.col("value"))))
    same = F.struct("tag", "value").eqNullSafe(F.col("back"))
    return back.groupBy("tag").agg(n().alias("rows"), n(~same).alias("changed"))


@query("label_intake", "SELECT CASE quality WHEN 1 THEN 'relevant' ELSE 'irrelevant' END AS etiqueta_texto, count(*) AS rows, count(*) AS noted FROM labels GROUP BY 1")
def label_intake(spark, sf):
    path = work_path(spark, "labels")
    table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("record_id"),
        F.when(F.col("quality") == 1, "relevant").otherwise("irrelevant").alias("etiqueta_texto"),
        F.when(F.col("toxic") == 1, 'says "no", rude').otherwise("NA").alias("notas_revision"),
    ).write.option("escape", '"').csv(path, header=True)
    return read_labels(spark, path).groupBy("etiqueta_texto").agg(n().alias("rows"), F.count("notas_revision").alias("noted"))


def _release(spark, sf):
    path = work_path(spark, "release")
    manifest = L.write_release(prepared_rows(raw_reviews(spark, sf)), path, lineage={"stage": "prepared"})
    return path, manifest


@query("release_manifest", over(PREPARED, "SELECT count(*) AS row_count, 1::BIGINT AS format_version, 'prepared' AS stage, 18::BIGINT AS columns FROM prepared"))
def release_manifest(spark, sf):
    return _release(spark, sf)[1].select(
        "row_count", "format_version", "stage", F.size(F.split("columns", ",")).cast("bigint").alias("columns"))


@query("verify_release", over(PREPARED, "SELECT true AS size_ok, true AS files_ok, true AS columns_ok, true AS rows_ok, true AS content_ok, count(*) AS row_count, true AS valid FROM prepared"))
def verify(spark, sf):
    return L.verify_release(spark, _release(spark, sf)[0])


@query("artifact_inventory")
def artifact_inventory(spark, sf):
    path, _ = _release(spark, sf)
    files = L.listing(spark, path)
    named = files.select(F.substring_index("path", "/", -1).alias("name"), "bytes")
    declared = named.where(F.col("name").endswith(".parquet"))
    status = L.release_status(L.reconcile_files(declared, named)).withColumn("scope", F.lit("(release)"))
    sizes = L.scope_sizes(files, path)
    return sizes.select("scope", F.col("objects").alias("count"), F.lit("listed").alias("status")).unionByName(
        status.select("scope", F.col("declared").alias("count"), "status"))


@query("catalog_latest", """
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1)
SELECT 'run-' || max(day) AS run_id, 'data-' || max(day) AS artifact_id, CAST(arg_max(n, day) AS BIGINT) AS rows,
  CAST((SELECT count(*) FROM d) AS BIGINT) AS publications, 0::BIGINT AS conflicts FROM d""")
def catalog_latest(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd")
    runs = table(spark, sf, "events").groupBy(day.alias("day")).agg(n().alias("rows")).select(
        F.datediff(F.col("day").cast("date"), F.lit("2000-01-01").cast("date")).alias("seq"),
        F.concat(F.lit("run-"), "day").alias("run_id"), F.concat(F.lit("data-"), "day").alias("artifact_id"),
        F.to_json(F.struct("rows")).alias("info"),
    )
    head = runs.agg(F.max("seq").alias("s")).scalar()
    catalogue = runs.where(F.col("seq") < head)
    fresh, conflicts = L.publish(catalogue, runs)
    published = catalogue.unionByName(fresh)
    return L.resolve(published).select(
        "run_id", "artifact_id", F.get_json_object("info", "$.rows").cast("bigint").alias("rows"),
        published.agg(n().alias("c")).scalar().alias("publications"), conflicts.agg(n().alias("c")).scalar().alias("conflicts"))


@query("verify_damaged_release", over(PREPARED, """
SELECT false AS size_ok, false AS files_ok, true AS columns_ok, false AS rows_ok, false AS content_ok, count(*) AS row_count, false AS valid,
  count(*) FILTER (WHERE platform <> 'x') AS found_rows FROM prepared"""))
def verify_damaged(spark, sf):
    """A release whose files of one platform were lost and whose ratings were changed after its manifest was written."""
    path, _ = _release(spark, sf)
    damaged = work_path(spark, "damaged")
    for part in ("manifest", "files"):
        spark.read.text(f"{path}/{part}").write.text(f"{damaged}/{part}")
    rows = spark.read.parquet(f"{path}/data").where(F.col("platform") != "x")
    rows.withColumn("rating", F.when(F.col("rating") == 1, F.lit(2)).otherwise(F.col("rating")).cast(rows.schema["rating"].dataType)) \
        .write.parquet(f"{damaged}/data")
    found = spark.read.parquet(f"{damaged}/data").agg(n().alias("found_rows"))
    return L.verify_release(spark, damaged).join(found, how="cross")


@query("file_reconcile", """
WITH d AS (SELECT 'day-' || strftime(ts, '%Y-%m-%d') AS name, count(*) * 10 AS bytes, day(min(ts)) AS k FROM events GROUP BY 1),
f AS (SELECT coalesce(a.name, b.name) AS name, a.bytes AS declared_bytes, b.bytes AS observed_bytes
  FROM (SELECT name, bytes FROM d WHERE k % 7 <> 3) a FULL OUTER JOIN
    (SELECT name, bytes + CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END AS bytes FROM d WHERE k % 5 <> 1) b ON a.name = b.name)
SELECT name, coalesce(declared_bytes, -1) AS declared_bytes, coalesce(observed_bytes, -1) AS observed_bytes,
  CASE WHEN observed_bytes IS NULL THEN 'incomplete' WHEN declared_bytes <> observed_bytes THEN 'invalid' WHEN declared_bytes IS NULL THEN 'undeclared' ELSE 'none' END AS issue FROM f""")
def file_reconcile(spark, sf):
    """A manifest of daily files against a listing with days lost, grown and not declared."""
    days = table(spark, sf, "events").groupBy(F.concat(F.lit("day-"), F.date_format("ts", "yyyy-MM-dd")).alias("name")).agg(
        (n() * 10).alias("bytes"), F.dayofmonth(F.min("ts")).alias("k"))
    declared = days.where(F.col("k") % 7 != 3)
    observed = days.where(F.col("k") % 5 != 1).withColumn("bytes", F.col("bytes") + F.when(F.col("k") % 4 == 2, 1).otherwise(0))
    return L.reconcile_files(declared, observed).na.fill(-1, ["declared_bytes", "observed_bytes"]).na.fill("none", ["issue"])


@query("settings_identity", """
SELECT lang AS language, sha256('{"language":' || CASE WHEN lang IS NULL THEN 'null' ELSE '"' || lang || '"' END || ',"longest":' || max(n_chars) || ',"rows":' || count(*) || '}') AS identity
FROM documents GROUP BY lang""")
def settings_identity(spark, sf):
    """One identity per language's settings: equal settings in any order have equal ones."""
    rows = table(spark, sf, "documents").groupBy(F.col("lang").alias("language")).agg(n().alias("rows"), F.max("n_chars").alias("longest"))
    return rows.select("language", Fe.identity_of({name: F.col(name) for name in ("rows", "longest", "language")}).alias("identity"))


_LINKS = """
WITH s AS (SELECT event_type AS stage, count(*) AS rows, lag(event_type) OVER (ORDER BY event_type) AS upstream FROM events GROUP BY 1),
u AS (SELECT s.*, p.rows AS before FROM s LEFT JOIN s p ON p.stage = s.upstream)
SELECT stage, upstream IS NULL OR stage <> 'error' AS input_matches, upstream IS NULL OR rows = before AS rows_match, rows % 2 = 0 AS finite,
  upstream IS NULL OR (stage < 'h') = (upstream < 'h') AS same_release FROM u"""


@query("broken_lineage", _LINKS)
def broken_lineage(spark, sf):
    """Stages linked by fingerprints, some to another input, with other rows, unfit values or another release."""
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(n().alias("rows"))
    # One row per event type.
    ordered = Window.orderBy("stage")
    stages = counts.withColumn("output_digest", F.sha2(F.concat_ws(":", "stage", "rows"), 256)).withColumns({
        "upstream": F.lag("stage").over(ordered), "linked": F.lag("output_digest").over(ordered),
        "nonfinite": F.col("rows") % 2, "release_id": F.when(F.col("stage") < "h", "r1").otherwise("r2")})
    return Fe.stage_lineage(stages.withColumn("input_digest", F.when(F.col("stage") == "error", F.lit("other")).otherwise(F.col("linked"))))


@query("problem_examples", """
WITH r AS (SELECT event_id AS source_row, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN ' ' WHEN event_id % 50 = 7 THEN 'same' || (event_id // 200) ELSE 'e' || event_id END AS record_id,
  CASE WHEN event_id % 40 = 11 THEN '  ' ELSE event_type END AS model_text FROM events),
b AS (SELECT *, trim(record_id) = '' AS bad_id, trim(model_text) = '' AS bad_text, count(*) OVER (PARTITION BY record_id) > 1 AS repeated FROM r)
SELECT source_row, CASE WHEN bad_id THEN 'row ' || source_row || ' has no id' ELSE record_id END AS example
FROM b WHERE bad_id OR bad_text OR repeated ORDER BY source_row LIMIT 40""")
def problem_examples(spark, sf):
    """The first rows without an id, with a repeated one or without text."""
    at = F.col("event_id")
    rows = table(spark, sf, "events").select(
        at.alias("source_row"),
        F.when((F.col("event_type") == "error") & (at % 3 == 0), " ").when(at % 50 == 7, F.concat(F.lit("same"), F.floor(at / 200).cast("string")))
        .otherwise(F.concat(F.lit("e"), at.cast("string"))).alias("record_id"),
        F.when(at % 40 == 11, "  ").otherwise(F.col("event_type")).alias("model_text"))
    return Fe.problem_examples(rows, "source_row", 40)
