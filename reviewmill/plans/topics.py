"""Topics over the review view: groups come from the vector labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import rounded
from ..operators import clusters as C
from ..operators import evidence as Ev
from ..operators import topics as K
from ..operators.ordered import page
from ..session import checkpointed, discard
from ..sources.tables import reviews, scored, table, vectors
from .registry import query
from .views import REVIEWS, over

STOP = ", ".join(f"'{w}'" for w in X.VECTORIZER_STOP_WORDS)
TOPICS = REVIEWS + """,
sizes AS (SELECT cluster_id, count(*) AS reviews FROM reviews GROUP BY 1),
numbers AS (SELECT cluster_id, reviews, CASE WHEN cluster_id = -1 THEN -1 ELSE CAST(row_number() OVER (ORDER BY cluster_id = -1, reviews DESC, cluster_id) - 1 AS INT) END AS topic_id FROM sizes),
t AS (SELECT r.*, n.topic_id FROM reviews r JOIN numbers n ON n.cluster_id = r.cluster_id)"""
TERMS = TOPICS + rf""",
terms AS (SELECT topic_id, source_row, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({STOP})) AS kept FROM t),
toks AS (SELECT topic_id, source_row, unnest(kept) AS w, unnest(range(1, len(kept) + 1)) AS i FROM terms),
seq AS (SELECT topic_id, source_row, i, w, lead(w) OVER (PARTITION BY topic_id ORDER BY source_row, i) AS nxt, lead(w) OVER (PARTITION BY source_row ORDER BY i) AS own_nxt FROM toks),
bow AS (SELECT topic_id, term, count(*) AS tf FROM (SELECT topic_id, w AS term FROM seq UNION ALL SELECT topic_id, w || ' ' || nxt FROM seq WHERE nxt IS NOT NULL) GROUP BY ALL)"""
WEIGHTS = TERMS + """,
words AS (SELECT topic_id, CAST(sum(tf) AS BIGINT) AS words FROM bow GROUP BY 1),
average AS (SELECT CAST(floor(avg(words)) AS BIGINT) AS a FROM words),
ft AS (SELECT term, CAST(sum(tf) AS BIGINT) AS f FROM bow GROUP BY 1),
wt AS (SELECT b.topic_id, b.term, tf, words, f, ln(1 + a::DOUBLE / f) AS idf, sqrt(tf::DOUBLE / words) * ln(1 + a::DOUBLE / f) AS weight
  FROM bow b JOIN words w ON w.topic_id = b.topic_id JOIN ft ON ft.term = b.term, average),
kw AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS INT) AS rank FROM wt QUALIFY rank <= 10),
lists AS (SELECT topic_id, list(term ORDER BY rank) AS keywords FROM kw GROUP BY 1)"""
REPS = WEIGHTS + """,
own AS (SELECT topic_id, source_row, term, count(*) AS times FROM (
  SELECT topic_id, source_row, w AS term FROM seq UNION ALL SELECT topic_id, source_row, w || ' ' || own_nxt FROM seq WHERE own_nxt IS NOT NULL) GROUP BY ALL),
tl AS (SELECT topic_id, sqrt(sum(weight * weight)) AS length FROM wt GROUP BY 1),
sc AS (SELECT o.topic_id, o.source_row, sum(sqrt(times::DOUBLE) * idf * weight) / (sqrt(sum(times * idf * idf)) * any_value(length)) AS score
  FROM own o JOIN wt ON wt.topic_id = o.topic_id AND wt.term = o.term JOIN tl ON tl.topic_id = o.topic_id GROUP BY 1, 2),
reps AS (SELECT topic_id, source_row, score, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY round(score, 9) DESC, source_row) AS INT) AS rank FROM sc QUALIFY rank <= 3)"""


def topic_rows(spark, sf, *parts):
    return K.with_topics(reviews(spark, sf, "groups", *parts))


def class_weights(rows):
    """Term weights; their counts are written, so a query may read them more than once."""
    return K.weighted_terms(K.class_terms(rows, totals=True))


def review_vectors(spark, sf):
    return vectors(spark, sf).select(F.col("vec_id").alias("source_row"), F.col("embedding").alias("vector"))


@query("topic_numbering", over(TOPICS, "SELECT cluster_id, topic_id, reviews FROM numbers"))
def topic_numbering(spark, sf):
    return K.topic_numbers(reviews(spark, sf, "groups"))


@query("topic_mapping", over(TOPICS, "SELECT 'group' AS kind, cluster_id AS value FROM t GROUP BY 2 HAVING count(DISTINCT topic_id) > 1"))
def topic_mapping(spark, sf):
    return K.mapping_problems(topic_rows(spark, sf))


@query("vectorizer_terms", over(TERMS, """
SELECT term, count(*) AS occurrences FROM (SELECT w AS term FROM seq UNION ALL SELECT w || ' ' || own_nxt FROM seq WHERE own_nxt IS NOT NULL) GROUP BY term"""))
def vectorizer_terms(spark, sf):
    return K.review_terms(topic_rows(spark, sf)).groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"))


@query("class_bow", over(TERMS, "SELECT * FROM bow"))
def class_bow(spark, sf):
    return K.class_terms(topic_rows(spark, sf))


@query("ctfidf", over(WEIGHTS, "SELECT topic_id, term, tf, words, f, round(idf, 6) AS idf, round(weight, 6) AS weight FROM wt"))
def ctfidf(spark, sf):
    return class_weights(topic_rows(spark, sf)).select("topic_id", "term", "tf", "words", "f", rounded(F.col("idf")).alias("idf"), rounded(F.col("weight")).alias("weight"))


@query("topic_keywords", over(WEIGHTS, "SELECT topic_id, rank, term, round(weight, 6) AS weight FROM kw"))
def topic_keywords(spark, sf):
    return K.keywords(class_weights(topic_rows(spark, sf))).select("topic_id", "rank", "term", rounded(F.col("weight")).alias("weight"))


@query("topic_info", over(WEIGHTS, """
SELECT n.topic_id, n.reviews, n.topic_id || '_' || array_to_string(keywords[1:4], '_') AS name, array_to_string(keywords, ',') AS keywords
FROM numbers n LEFT JOIN lists l ON l.topic_id = n.topic_id"""))
def topic_info(spark, sf):
    rows = topic_rows(spark, sf)
    return K.topic_info(rows, K.keywords(class_weights(rows))).withColumn("keywords", F.array_join("keywords", ","))


WALK = WEIGHTS + """,
walk AS (SELECT topic_id, term, tf, f, idf, weight, row_number() OVER (PARTITION BY topic_id ORDER BY tf DESC, term) AS rank_count,
  row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS rank_weight FROM wt QUALIFY rank_count <= 12 OR rank_weight <= 10)"""


@query("term_walk", over(WALK, "SELECT topic_id, term, tf, f, round(idf, 6) AS idf, round(weight, 6) AS weight, rank_count, rank_weight FROM walk"))
def term_walk(spark, sf):
    return K.term_walk(class_weights(topic_rows(spark, sf))).withColumn("idf", rounded(F.col("idf"))).withColumn("weight", rounded(F.col("weight")))


@query("generic_terms", over(WALK, "SELECT topic_id, term, rank_count, rank_weight FROM walk WHERE rank_count <= 3 AND rank_weight > 20"))
def generic_terms(spark, sf):
    return K.generic_terms(K.term_walk(class_weights(topic_rows(spark, sf)))).select("topic_id", "term", "rank_count", "rank_weight")


@query("tfidf_contrast", over(REPS, """,
d AS (SELECT term, count(*) AS holding, max(times) AS most FROM own WHERE term IN (SELECT term FROM kw) GROUP BY 1)
SELECT k.topic_id, k.term, round(weight, 6) AS weight, round(tf::DOUBLE / words * idf, 6) AS plain_weight, coalesce(holding, 0) AS holding,
  round(coalesce(most * ln((SELECT count(*) FROM t) / holding::DOUBLE), 0), 6) AS classic_weight FROM kw k LEFT JOIN d ON d.term = k.term"""))
def tfidf_contrast(spark, sf):
    rows = topic_rows(spark, sf)
    table = K.tfidf_contrast(rows, checkpointed(K.keywords(class_weights(rows))))
    return table.select("topic_id", "term", *[rounded(F.col(c)).alias(c) for c in ("weight", "plain_weight", "classic_weight")], "holding")


def reps(spark, sf):
    rows = topic_rows(spark, sf)
    lengths, products = K.scored_terms(rows, listed=False)
    return rows, K.representatives(products, lengths)


@query("representative_reviews", over(REPS, "SELECT topic_id, rank, source_row, round(score, 6) AS score FROM reps"))
def representative_reviews(spark, sf):
    return reps(spark, sf)[1].withColumn("score", rounded(F.col("score")))


def candidates(spark, sf):
    """Rows, the weights of their leading terms, and each topic's candidates (a fixed number, pinned)."""
    rows = topic_rows(spark, sf)
    worded = K.with_terms(rows)
    weights, lengths, products = K.leading_scores(worded, K.CANDIDATES)
    found = checkpointed(K.semantic_candidates(worded, review_vectors(spark, sf), weights, K.representatives(products, lengths)))
    discard(worded)
    return rows, weights, found


@query("keywords_semantic")
def keywords_semantic(spark, sf):
    return K.semantic_keywords(candidates(spark, sf)[2]).select("topic_id", "rank", "term", rounded(F.col("similarity")).alias("similarity"))


@query("keywords_mmr")
def keywords_mmr(spark, sf):
    _, _, found = candidates(spark, sf)
    parts = [K.diverse_keywords(found, d).withColumn("diversity", F.lit(d)) for d in (0.3, 0.7)]
    return parts[0].unionByName(parts[1]).withColumn("similarity", rounded(F.col("similarity")))


@query("representation_table")
def representation_table(spark, sf):
    rows, weights, found = candidates(spark, sf)
    return K.representation_table(rows, {
        "ctfidf": K.keywords(weights), "semantic": K.semantic_keywords(found),
        "mmr_03": K.diverse_keywords(found, 0.3), "mmr_07": K.diverse_keywords(found, 0.7),
    })


@query("topic_search", over(WEIGHTS, "SELECT topic_id, array_to_string(keywords, ',') AS keywords FROM lists WHERE len(list_filter(keywords, lambda k: contains(k, 'on'))) > 0"))
def topic_search(spark, sf):
    lists = K.keyword_lists(K.keywords(class_weights(topic_rows(spark, sf))))
    return K.topic_search(lists, " ON ").withColumn("keywords", F.array_join("keywords", ","))


@query("topic_objects", over(REPS, """
SELECT b.topic_id, cluster_id, reviews AS review_count, (SELECT string_agg(term || '=' || printf('%.4f', weight), ',' ORDER BY weight DESC, term) FROM kw WHERE kw.topic_id = b.topic_id) AS keywords,
  (SELECT string_agg(source_row, ',' ORDER BY rank) FROM reps WHERE reps.topic_id = b.topic_id) AS representatives FROM numbers b WHERE b.topic_id >= 0"""))
def topic_objects(spark, sf):
    rows = topic_rows(spark, sf)
    weights, lengths, products = K.leading_scores(rows, K.TOP_KEYWORDS)
    objects = K.topic_objects(rows, K.keywords(weights), K.representatives(products, lengths))
    shown = F.transform("keywords", lambda k: F.format_string("%s=%.4f", k["term"], k["c_tf_idf_weight"]))
    return objects.select("topic_id", "cluster_id", "review_count", F.array_join(shown, ",").alias("keywords"),
                          F.array_join(F.col("representative_rows").cast("array<string>"), ",").alias("representatives"))


@query("topic_object_problems", over(REPS, """
SELECT topic_id, 'foreign_representative' AS rule FROM reps WHERE topic_id >= 0 AND source_row % 3 = 0
UNION ALL SELECT topic_id, 'several_groups' FROM numbers WHERE topic_id >= 0 AND topic_id % 2 = 1"""))
def topic_object_problems(spark, sf):
    """Topic records against members of which a third was dropped, every second topic said to join two groups."""
    rows = topic_rows(spark, sf)
    weights, lengths, products = K.leading_scores(rows, K.TOP_KEYWORDS)
    objects = K.topic_objects(rows, K.keywords(weights), K.representatives(products, lengths))
    objects = objects.withColumn("clusters", F.col("clusters") + F.col("topic_id") % 2)
    return K.topic_object_problems(objects, rows.where(F.col("source_row") % 3 != 0))


@query("topic_members", over(TOPICS, "SELECT topic_id, cluster_id, record_id, source_row, probability FROM t WHERE topic_id = 0"))
def topic_members(spark, sf):
    return K.topic_members(topic_rows(spark, sf), 0)


@query("keyword_comparison", over(WEIGHTS, """,
c AS (SELECT topic_id, term, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY tf DESC, term) AS INT) AS rank FROM wt QUALIFY rank <= 10)
SELECT coalesce(k.topic_id, c.topic_id) AS topic_id, coalesce(k.term, c.term) AS term, c.rank AS rank_before, k.rank AS rank_after,
  CASE WHEN k.rank IS NULL THEN 'only before' WHEN c.rank IS NULL THEN 'only after' ELSE 'shared' END AS note, c.rank - k.rank AS moved
FROM c FULL OUTER JOIN kw k ON k.topic_id = c.topic_id AND k.term = c.term"""))
def keyword_comparison(spark, sf):
    return _comparison(spark, sf)


def _comparison(spark, sf):
    weights = class_weights(topic_rows(spark, sf))
    by_count = K.leading_terms(weights, "tf", 10)
    return K.keyword_comparison(by_count, K.keywords(weights))


@query("keyword_comparison_summary", over(WEIGHTS, """,
c AS (SELECT topic_id, term, row_number() OVER (PARTITION BY topic_id ORDER BY tf DESC, term) AS rank FROM wt QUALIFY rank <= 10),
w AS (SELECT topic_id, count(DISTINCT x) FILTER (WHERE side = 'b') AS words_before, count(DISTINCT x) FILTER (WHERE side = 'a') AS words_after FROM (
  SELECT topic_id, 'b' AS side, unnest(string_split(term, ' ')) AS x FROM c UNION ALL SELECT topic_id, 'a', unnest(string_split(term, ' ')) FROM kw) GROUP BY 1)
SELECT k.topic_id, count(c.term) AS kept, count(*) AS of, any_value(words_before) AS words_before, any_value(words_after) AS words_after
FROM kw k LEFT JOIN c ON c.topic_id = k.topic_id AND c.term = k.term JOIN w ON w.topic_id = k.topic_id GROUP BY 1"""))
def keyword_comparison_summary(spark, sf):
    return K.keyword_comparison_summary(_comparison(spark, sf))


# -- groups ----------------------------------------------------------------

@query("cluster_summary", over(REVIEWS, """,
p AS (SELECT cluster_id, platform, count(*) AS c FROM reviews GROUP BY 1, 2),
m AS (SELECT cluster_id, string_agg(platform || ' ' || c, ', ' ORDER BY c DESC, platform) AS platforms FROM p GROUP BY 1),
e AS (SELECT cluster_id, string_agg(substr(text, 1, 60), ' | ' ORDER BY probability DESC, source_row) AS examples FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY probability DESC, source_row) AS k FROM reviews QUALIFY k <= 3) GROUP BY 1)
SELECT r.cluster_id, count(*) AS size, round(avg(probability), 6) AS mean_probability, round(count(*)::DOUBLE / (SELECT count(*) FROM reviews), 6) AS share,
  any_value(m.platforms) AS platforms, any_value(e.examples) AS examples, round(avg(x), 6) AS centre_x, round(avg(y), 6) AS centre_y
FROM (SELECT r.*, v.embedding[1]::DOUBLE AS x, v.embedding[2]::DOUBLE AS y FROM reviews r LEFT JOIN embeddings v ON v.vec_id = r.source_row) r
JOIN m ON m.cluster_id = r.cluster_id JOIN e ON e.cluster_id = r.cluster_id WHERE r.cluster_id >= 0 GROUP BY 1"""))
def cluster_summary(spark, sf):
    flat = vectors(spark, sf).select(F.col("vec_id").alias("source_row"), F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return C.cluster_summary(reviews(spark, sf, "groups").join(flat, "source_row", "left"))


@query("cluster_members", over(REVIEWS, """
SELECT record_id, platform, probability FROM reviews WHERE cluster_id = 3 AND contains(lower(text), 'en') ORDER BY probability DESC, source_row LIMIT 8 OFFSET 8"""))
def cluster_members(spark, sf):
    rows = C.group_members(reviews(spark, sf, "groups"), 3, " EN ")
    return page(rows, C.member_order(), 1, 8).select("record_id", "platform", "probability")


@query("assignment_counts", over(REVIEWS, """
SELECT count(DISTINCT cluster_id) FILTER (WHERE cluster_id >= 0) AS groups, count(*) FILTER (WHERE cluster_id >= 0) AS assigned,
  count(*) FILTER (WHERE cluster_id = -1) AS unassigned, count(*) AS rows, true AS adds_up FROM reviews"""))
def assignment_counts(spark, sf):
    return C.assignment_counts(reviews(spark, sf, "groups"))


# -- evidence --------------------------------------------------------------

EVIDENCE = REPS + """,
pr AS (SELECT t.*, coalesce(r.rank, 1000000) AS first FROM t LEFT JOIN reps r ON r.source_row = t.source_row WHERE t.topic_id >= 0)"""


@query("topic_evidence", over(EVIDENCE, """
SELECT topic_id, 'e' || rank AS alias, CAST(rank AS INT) AS rank, record_id, substr(text, 1, 900) AS excerpt, length(text) > 900 AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY first, probability DESC, source_row) AS rank FROM pr QUALIFY rank <= 6)"""))
def topic_evidence(spark, sf):
    return Ev.topic_evidence(*reps(spark, sf))


@query("topic_evidence_earliest", over(EVIDENCE, """
SELECT topic_id, 'e' || rank AS alias, CAST(rank AS INT) AS rank, record_id, length(text) > 900 AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY first, source_row) AS rank FROM pr QUALIFY rank <= 6)"""))
def topic_evidence_earliest(spark, sf):
    return Ev.topic_evidence(*reps(spark, sf), firmest=False).drop("excerpt")


@query("topic_evidence_distinct", over(EVIDENCE, """,
big AS (SELECT topic_id FROM numbers WHERE topic_id >= 0 ORDER BY reviews DESC, topic_id LIMIT 20),
d AS (SELECT topic_id, text, min(first * 10000000000 + source_row) AS pos, arg_min(record_id, source_row) AS record_id FROM pr WHERE topic_id IN (SELECT topic_id FROM big) GROUP BY 1, 2)
SELECT topic_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY pos) AS INT) AS rank, record_id, substr(text, 1, 600) AS excerpt, length(text) > 600 AS truncated
FROM d QUALIFY rank <= 5"""))
def topic_evidence_distinct(spark, sf):
    return Ev.distinct_evidence(*reps(spark, sf))


def attempts(spark, sf):
    """Conversations read as naming attempts: a conversation is a topic, an answer an attempt."""
    topic, turn = F.col("conv_id"), F.col("turn")
    response = F.to_json(F.struct(
        F.when(topic % 2 == 0, F.concat(F.lit("feature "), topic.cast("string"))).alias("proposed_feature"),
        F.col("text").alias("topic_description"),
        F.array(F.concat(F.lit("e"), (turn % 4 + 1).cast("string")), F.concat(F.lit("e"), ((topic + turn) % 8 + 1).cast("string"))).alias("supporting_review_ids"),
        F.element_at(F.array(*[F.lit(a) for a in ("single_feature", "mixed", "unclear", "other")]), ((topic + turn) % 4 + 1).cast("int")).alias("assessment"),
    ))
    return table(spark, sf, "conversations").where(F.col("role") == "assistant").select(
        topic.alias("topic_id"), F.format_string("a%03d", turn).alias("attempt_id"),
        F.format_string("2024-01-01T00:%02d", turn).alias("created_at"), response.alias("response"),
        F.array(*[F.lit(f"e{i}") for i in range(1, 7)]).alias("evidence"),
        F.when((topic + turn) % 4 == 3, "failed").otherwise("completed").alias("status"),
        F.sha2(F.col("text"), 256).alias("fingerprint"),
    )


ATTEMPTS = """
attempts AS (SELECT conv_id AS topic_id, 'a' || lpad(CAST(turn AS VARCHAR), 3, '0') AS attempt_id, turn, text, sha256(text) AS fingerprint,
  CASE WHEN conv_id % 2 = 0 THEN 'feature ' || conv_id END AS feature, 'e' || (turn % 4 + 1) AS c1, 'e' || ((conv_id + turn) % 8 + 1) AS c2,
  ['single_feature', 'mixed', 'unclear', 'other'][(conv_id + turn) % 4 + 1] AS assessment, CASE WHEN (conv_id + turn) % 4 = 3 THEN 'failed' ELSE 'completed' END AS status
  FROM conversations WHERE role = 'assistant'),
latest AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY turn DESC) = 1),
asked AS (SELECT DISTINCT conv_id AS topic_id FROM conversations)"""


@query("validate_interpretations", over(ATTEMPTS, """
SELECT topic_id, attempt_id, 'unknown_assessment' AS rule FROM attempts WHERE assessment = 'other'
UNION ALL SELECT topic_id, attempt_id, 'empty_description' FROM attempts WHERE text = ''
UNION ALL SELECT topic_id, attempt_id, 'repeated_citation' FROM attempts WHERE c1 = c2
UNION ALL SELECT topic_id, attempt_id, 'foreign_citation' FROM attempts WHERE c2 IN ('e7', 'e8')
UNION ALL SELECT topic_id, attempt_id, 'feature_must_be_null' FROM attempts WHERE assessment IN ('mixed', 'unclear') AND feature IS NOT NULL"""))
def validate_interpretations(spark, sf):
    return Ev.response_problems(attempts(spark, sf))


def interpreted(spark, sf):
    asked = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("topic_id")).agg(F.count(F.lit(1)).alias("reviews"))
    return Ev.latest_interpretation(asked, attempts(spark, sf))


@query("latest_interpretation", over(ATTEMPTS, """
SELECT a.topic_id, l.attempt_id, coalesce(l.status, 'pending') AS interpretation_status, CASE WHEN l.status = 'completed' THEN l.assessment END AS assessment
FROM asked a LEFT JOIN latest l ON l.topic_id = a.topic_id"""))
def latest_interpretation(spark, sf):
    return interpreted(spark, sf).select("topic_id", "attempt_id", "interpretation_status", F.col("r.assessment").alias("assessment"))


@query("pending_requests", over(ATTEMPTS, """
SELECT topic_id, attempt_id FROM attempts WHERE fingerprint NOT IN (SELECT fingerprint FROM attempts WHERE status = 'completed')"""))
def pending_requests(spark, sf):
    tried = attempts(spark, sf)
    return Ev.pending_requests(tried.select("topic_id", "attempt_id", "fingerprint"), tried.where(F.col("status") == "completed")).select("topic_id", "attempt_id")


LABELS = ATTEMPTS + """,
labels_ AS (SELECT l.topic_id, (SELECT count(*) FROM conversations c WHERE c.conv_id = l.topic_id) AS reviews, coalesce(feature, '—') AS label, assessment, 2::INT AS cited
  FROM latest l WHERE status = 'completed')"""


@query("label_summary", over(LABELS, "SELECT * FROM labels_"))
def label_summary(spark, sf):
    return Ev.label_summary(interpreted(spark, sf))


@query("assessment_counts", over(LABELS, "SELECT assessment, count(*) AS topics, CAST(sum(reviews) AS BIGINT) AS reviews FROM labels_ GROUP BY 1"))
def assessment_counts(spark, sf):
    return Ev.assessment_counts(Ev.label_summary(interpreted(spark, sf)))


@query("labels_by_assessment", over(WEIGHTS + ", " + LABELS.strip(), """
SELECT l.*, array_to_string(k.keywords[1:4], ' · ') AS keywords FROM labels_ l LEFT JOIN lists k ON k.topic_id = l.topic_id WHERE assessment = 'mixed'"""))
def labels_by_assessment(spark, sf):
    lists = K.keyword_lists(K.keywords(class_weights(topic_rows(spark, sf))))
    return Ev.labels_by_assessment(Ev.label_summary(interpreted(spark, sf)), lists, "mixed")


@query("join_topic_sentiment", over(TOPICS, """
SELECT topic_id, CASE WHEN topic_id % 4 = 3 THEN 'missing_summary' WHEN topic_id % 4 = 2 THEN 'release_differs' END AS problem FROM numbers WHERE topic_id >= 0"""))
def join_topic_sentiment(spark, sf):
    topics = K.topic_numbers(reviews(spark, sf, "groups")).where(F.col("topic_id") >= 0).select(
        F.lit("run").alias("topic_run_id"), "topic_id", F.lit("release").alias("dataset_release_id"))
    rows = scored(topic_rows(spark, sf))
    net = (F.count_if(F.col("sentiment") == "positive") - F.count_if(F.col("sentiment") == "negative")) / F.count(F.lit(1))
    summaries = rows.where((F.col("topic_id") >= 0) & (F.col("topic_id") % 4 != 3)).groupBy("topic_id").agg(net.alias("net_sentiment")).select(
        F.lit("run").alias("topic_run_id"), "topic_id", F.when(F.col("topic_id") % 4 == 2, "other").otherwise("release").alias("dataset_release_id"), "net_sentiment")
    return Ev.join_topic_sentiment(topics, summaries).select("topic_id", "problem")
