"""Selection, encoding and similarity over the review and vector tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import blocks as B
from ..operators import features as Fe
from ..operators import lists as Ls
from ..operators import neighbours as N
from ..session import stored
from ..sources.tables import reviews, vectors
from .registry import query
from .views import REVIEWS, over

LIMIT = 150
ROW = 7
PAIRS = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_dot_product(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
top AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) AS rank, neighbour, score FROM p QUALIFY rank <= 5)"""
FLAT = """
f AS (SELECT vec_id, CAST(embedding[1:2] AS DOUBLE[]) AS e FROM embeddings),
fp AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, sqrt((a.e[1] - b.e[1]) ** 2 + (a.e[2] - b.e[2]) ** 2) AS gap FROM f a JOIN f b ON a.vec_id <> b.vec_id),
near AS (SELECT id, neighbour FROM fp QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap, neighbour) <= 5)"""


@query("validate_reviews", over(REVIEWS, """
SELECT count(*) AS rows, 0::BIGINT AS invalid_id_rows, CAST(coalesce((SELECT sum(c) FROM (SELECT count(*) AS c FROM reviews GROUP BY record_id HAVING count(*) > 1)), 0) AS BIGINT) AS duplicate_id_rows,
  count(*) FILTER (WHERE model_text = '') AS invalid_text_rows, count(*) FILTER (WHERE model_text = '') = 0 AS valid FROM reviews"""))
def validate_reviews(spark, sf):
    return Fe.validate_reviews(reviews(spark, sf))


def _source(spark, sf):
    return reviews(spark, sf).select("source_row", "record_id", "model_text")


@query("first_n_selection", over(REVIEWS, f"""
SELECT source_row AS pinned_row, record_id, sha256(model_text) AS source_text_hash FROM reviews ORDER BY source_row LIMIT {LIMIT}"""))
def first_n_selection(spark, sf):
    return Fe.features(Fe.pin_selection(_source(spark, sf), ["source_row"], LIMIT)).select("pinned_row", "record_id", "source_text_hash")


@query("full_selection", over(REVIEWS, """
SELECT row_number() OVER (ORDER BY record_id) - 1 AS pinned_row, record_id FROM reviews"""))
def full_selection(spark, sf):
    return Fe.pin_selection(_source(spark, sf).drop("source_row"), ["record_id"]).select("pinned_row", "record_id")


def _featured(spark, sf):
    return Fe.features(_source(spark, sf))


@query("feature_counts", over(REVIEWS, """
SELECT count(*) AS rows, 0::BIGINT AS changed_rows, count(DISTINCT model_text) AS source_unique_texts, count(DISTINCT model_text) AS prepared_unique_texts FROM reviews"""))
def feature_counts(spark, sf):
    return Fe.feature_counts(_featured(spark, sf))


@query("unique_texts", over(REVIEWS, "SELECT sha256(model_text) AS input_hash, count(*) AS rows FROM reviews GROUP BY 1"))
def unique_texts(spark, sf):
    return Fe.unique_texts(_featured(spark, sf)).select("input_hash", "rows")


def _cache(spark, sf):
    """Vectors kept from an earlier run over one language, for two encoders."""
    earlier = Fe.unique_texts(Fe.features(
        reviews(spark, sf).where(F.col("language") == "en").select("record_id", "model_text")))
    held = Fe.encode_texts(earlier, Fe.bag_encoder(64))
    return held.select(F.explode(F.array(F.lit("bag-64"), F.lit("other"))).alias("encoder_id"), "*")


@query("cache_plan", over(REVIEWS, """
SELECT input_hash, bool_or(en) AS held FROM (SELECT sha256(model_text) AS input_hash, coalesce(language = 'en', false) AS en FROM reviews) GROUP BY 1"""))
def cache_plan(spark, sf):
    held, missing = Fe.cache_plan(Fe.unique_texts(_featured(spark, sf)), _cache(spark, sf), "bag-64")
    return held.select("input_hash", F.lit(True).alias("held")).unionByName(missing.select("input_hash", F.lit(False).alias("held")))


@query("encode_reviews")
def encode_reviews(spark, sf):
    rows, _ = Fe.encode_reviews(_featured(spark, sf), _cache(spark, sf), "bag-64", Fe.bag_encoder(64))
    return rows.select("source_row", "record_id", "feature_text_hash", F.size("vector").alias("dimensions"), "tokens", "reused")


@query("encoding_report", over(REVIEWS, """,
t AS (SELECT model_text, count(*) AS n, bool_or(coalesce(language = 'en', false)) AS held, len(regexp_extract_all(model_text, '[^\\s\\x{85}\\x{a0}\\p{Z}]+')) + 2 AS tokens FROM reviews GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS unique_texts, count(*) FILTER (WHERE NOT held) AS encoded_unique, count(*) FILTER (WHERE held) AS reused_unique,
  count(*) FILTER (WHERE tokens > 128) AS truncated_unique, CAST(coalesce(sum(n) FILTER (WHERE tokens > 128), 0) AS BIGINT) AS truncated_rows, CAST(max(tokens) AS INT) AS max_tokens FROM t"""))
def encoding_report(spark, sf):
    rows, _ = Fe.encode_reviews(_featured(spark, sf), _cache(spark, sf), "bag-64", Fe.bag_encoder(64))
    return Fe.encoding_report(rows)


@query("vector_validation", """
SELECT count(*) AS rows, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_size, 0::BIGINT AS nonfinite,
  count(*) FILTER (WHERE abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-4) AS not_unit FROM embeddings""")
def vector_validation(spark, sf):
    return Fe.vector_validation(vectors(spark, sf), "embedding", 64)


@query("reconcile_embeddings", over(REVIEWS, """
SELECT count(*) AS rows, count(DISTINCT model_text) AS unique_texts, 0::BIGINT AS repeated_ids, 0::BIGINT AS hash_of_source_text, 0::BIGINT AS hash_of_feature_text,
  0::BIGINT AS text_policy, 0::BIGINT AS positions_differ, 0::BIGINT AS not_in_source, min(source_row) = 0 AND max(source_row) = count(*) - 1 AS contiguous FROM reviews"""))
def reconcile_embeddings(spark, sf):
    source = _source(spark, sf)
    release = Fe.features(source).withColumn("vector_row", F.col("source_row"))
    return Fe.reconcile_release(release, source)


def _context(spark, sf):
    return reviews(spark, sf).select(F.col("source_row").alias("vec_id"), "record_id", "platform")


@query("attach_context", over(REVIEWS, """
SELECT v.vec_id, r.record_id, r.platform FROM embeddings v JOIN reviews r ON r.source_row = v.vec_id WHERE r.platform IN ('x', 'youtube')"""))
def attach_context(spark, sf):
    return Fe.attach_context(vectors(spark, sf).select("vec_id"), _context(spark, sf), "vec_id", ["x", "youtube"])


@query("context_problems", """
SELECT count(*) FILTER (WHERE d.doc_id IS NULL) AS without_context, count(*) FILTER (WHERE v.vec_id IS NULL) AS without_vector,
  0::BIGINT AS repeated_vectors, 0::BIGINT AS repeated_context FROM embeddings v FULL OUTER JOIN documents d ON d.doc_id = v.vec_id""")
def context_problems(spark, sf):
    return Fe.context_problems(vectors(spark, sf), _context(spark, sf), "vec_id")


@query("seeded_sample", over(REVIEWS, """
SELECT record_id, source_row, platform, sha256(model_text) AS text_hash FROM reviews ORDER BY sha256('42:' || record_id), record_id LIMIT 100"""))
def seeded_sample(spark, sf):
    return Fe.seeded_sample(reviews(spark, sf).select("record_id", "source_row", "platform", "text_hash"), "record_id", 100)


@query("prepared_inputs", over(REVIEWS, """
SELECT count(*) AS rows, count(*) - count(DISTINCT model_text) AS duplicate_texts, max(length(model_text)) AS max_length,
  round(median(length(model_text))::DOUBLE, 6) AS median_length FROM reviews WHERE model_text <> ''"""))
def prepared_inputs(spark, sf):
    return Fe.input_summary(Fe.prepared_inputs(reviews(spark, sf)))


@query("sample_reconcile", "SELECT count(*) AS rows, 0::BIGINT AS repeated_ids, 0::BIGINT AS missing, count(*) FILTER (WHERE lang = 'de') AS different FROM documents")
def sample_reconcile(spark, sf):
    release = reviews(spark, sf).select("record_id", "platform", "language", "text_hash")
    sample = release.withColumn("platform", F.when(F.col("language") == "de", "web").otherwise(F.col("platform")))
    return Fe.sample_reconcile(sample, release)


@query("stage_lineage")
def stage_lineage(spark, sf):
    """Inputs, vectors and eight-bit copies of the vector table, linked by fingerprint."""
    table = vectors(spark, sf).select("vec_id", "embedding", F.to_json("embedding").alias("body"))
    copies = N.quantise(table, "vec_id", "embedding").select("vec_id", F.to_json("quantised").alias("body"))
    vector_stage = Fe.stage_record(table, "vectors", "vec_id", ["body"], "embedding")
    copy_stage = Fe.stage_record(copies, "copies", "vec_id", ["body"])
    linked = vector_stage.select("output_digest").scalar()
    none = F.lit(None).cast("string")
    stages = vector_stage.withColumn("upstream", none).withColumn("input_digest", none).unionByName(
        copy_stage.withColumn("upstream", F.lit("vectors")).withColumn("input_digest", linked)
    ).withColumn("release_id", F.lit("r1"))
    return Fe.stage_lineage(stages)


@query("neighbours_one", f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.vec_id AS neighbour, round(list_dot_product(a.e, b.e), 6) AS score FROM v a, v b WHERE b.vec_id = {ROW} AND a.vec_id <> {ROW}
ORDER BY list_dot_product(a.e, b.e) DESC, neighbour LIMIT 5""")
def neighbours_one(spark, sf):
    return N.neighbours_of(vectors(spark, sf), "vec_id", "embedding", ROW).withColumn("score", rounded(F.col("score")))


@query("knn_top5", f"WITH {PAIRS.strip()} SELECT id, CAST(rank AS INT) AS rank, neighbour, round(score, 6) AS score FROM top")
def knn_top5(spark, sf):
    return B.nearest(vectors(spark, sf), "vec_id", "embedding").withColumn("score", rounded(F.col("score")))


@query("knn_probe_recall", """
WITH q AS (SELECT count(*) FILTER (WHERE vec_id % 50 = 0) AS asked FROM embeddings)
SELECT asked, 5 * asked AS expected, 5 * asked AS answered, true AS many_lists, true AS recalled FROM q""")
def knn_probe_recall(spark, sf):
    """Every 50th vector's neighbours from most of many lists (these vectors hardly form groups) against the exact ones."""
    table = vectors(spark, sf)
    queries = table.where(F.col("vec_id") % 50 == 0).select("vec_id")
    exact = B.nearest(table, "vec_id", "embedding").join(queries.withColumnRenamed("vec_id", "id"), "id", "left_semi")
    found = stored(Ls.nearest_in_lists(table, "vec_id", "embedding", probe=28, queries=queries, lists=32), "found")
    lists = len(Ls.built(B.distinct_vectors(table.select("vec_id", "embedding"), "vec_id", "embedding")[0], 32)[1].second)
    return N.recall(exact, found).select(
        F.lit(queries.count()).cast("bigint").alias("asked"), "expected", F.lit(found.count()).cast("bigint").alias("answered"),
        F.lit(lists >= 16).alias("many_lists"), (F.col("found") >= 0.95 * F.col("expected")).alias("recalled"))


@query("quantise_int8", """
WITH m AS (SELECT max(list_max(list_transform(embedding, lambda x: abs(x))))::DOUBLE AS m FROM embeddings)
SELECT vec_id, round(m / 127, 9) AS scale, array_to_string(list_transform(embedding, lambda x: CAST(greatest(least(round_even(x::DOUBLE / m * 127, 0), 127), -127) AS INT)), ',') AS quantised
FROM embeddings, m""")
def quantise_int8(spark, sf):
    return N.quantise(vectors(spark, sf), "vec_id", "embedding").select(
        "vec_id", rounded(F.col("scale"), 9).alias("scale"), F.array_join(F.col("quantised").cast("array<string>"), ",").alias("quantised"))


@query("dimension_spread", """
SELECT CAST(i - 1 AS INT) AS dimension, round(stddev_pop(embedding[i]::DOUBLE), 6) AS spread FROM embeddings, range(1, 65) r(i) GROUP BY i""")
def dimension_spread(spark, sf):
    return N.dimension_spread(vectors(spark, sf), "embedding").withColumn("spread", rounded(F.col("spread")))


@query("axis_limit", "SELECT round(quantile_cont(x, 0.995), 6) AS axis_limit FROM (SELECT abs(unnest(embedding)::DOUBLE) AS x FROM embeddings)")
def axis_limit(spark, sf):
    return N.axis_limit(vectors(spark, sf), "embedding").select(rounded(F.col("quantile")).alias("axis_limit"))


THRESHOLD = 0.35


@query("divergent_pair", over(REVIEWS, f""",
{PAIRS.strip()},
s AS (SELECT list(x ORDER BY i) AS spread FROM (SELECT i, stddev_pop(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY i)),
w AS (SELECT source_row, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+', ' ', 'g')) AS wording FROM reviews),
g AS (SELECT p.id, p.neighbour, p.score, list_transform(range(1, 65), lambda i: abs(a.e[i] - b.e[i]) / s.spread[i]) AS gap
  FROM p JOIN v a ON a.vec_id = p.id JOIN v b ON b.vec_id = p.neighbour LEFT JOIN w wa ON wa.source_row = p.id LEFT JOIN w wb ON wb.source_row = p.neighbour, s
  WHERE p.id < p.neighbour AND p.score >= {THRESHOLD} AND coalesce(wa.wording, '') <> coalesce(wb.wording, '')),
h AS (SELECT *, list_sort(gap, 'DESC') AS o FROM g)
SELECT round(sqrt(o[1] ** 2 + o[2] ** 2), 6) AS score, id AS a, neighbour AS b, round(score, 6) AS similarity,
  list_position(gap, o[64]) - 1 || ',' || (list_position(gap, o[63]) - 1) AS close_dimensions,
  list_position(gap, o[1]) - 1 || ',' || (list_position(gap, o[2]) - 1) AS far_dimensions
FROM h ORDER BY sqrt(o[1] ** 2 + o[2] ** 2) DESC, id, neighbour LIMIT 1"""))
def divergent_pair(spark, sf):
    rows = vectors(spark, sf).join(reviews(spark, sf).select(F.col("source_row").alias("vec_id"), "text"), "vec_id", "left").withColumn(
        "text", F.coalesce("text", F.lit("")))
    dims = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return N.divergent_pair(rows, "vec_id", "embedding", "text", THRESHOLD).select(
        rounded(F.col("score")).alias("score"), "a", "b", rounded(F.col("similarity")).alias("similarity"), dims("close_dimensions"), dims("far_dimensions"))


def _flat(spark, sf):
    """The first two coordinates stand for a map."""
    return vectors(spark, sf).select("vec_id", F.slice("embedding", 1, 2).alias("vector"))


def _full(spark, sf):
    return vectors(spark, sf).select("vec_id", F.col("embedding").alias("vector"))


@query("neighbour_overlap", f"""WITH {PAIRS.strip()}, {FLAT.strip()}
SELECT count(DISTINCT t.id) AS rows, round(count(n.id) / 5.0::DOUBLE / count(DISTINCT t.id), 6) AS overlap
FROM top t LEFT JOIN near n ON n.id = t.id AND n.neighbour = t.neighbour""")
def neighbour_overlap(spark, sf):
    return N.neighbourhood_overlap(_full(spark, sf), _flat(spark, sf), "vec_id")


@query("map_overlap", f"""WITH {PAIRS.strip()}, {FLAT.strip()}
SELECT count(*) AS kept, 5::INT AS of FROM top t JOIN near n ON n.id = t.id AND n.neighbour = t.neighbour WHERE t.id = {ROW}""")
def map_overlap(spark, sf):
    return N.map_overlap(_full(spark, sf), _flat(spark, sf), "vec_id", ROW)
