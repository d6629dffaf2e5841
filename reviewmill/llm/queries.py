"""The dealt operators as registered queries, with SQL where SQL can say the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import (
    decontaminate, edit_counts, fixity, jaccard_join, line_rules, multi_index, piece_lattice, runs, secrets, simplex_clusters,
    templates, token_files, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql.strip()
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PAGES_SQL = r"""
WITH a AS (
    SELECT page_id, url, regexp_extract(COALESCE(html, ''), '(?is)<article[^>]*>(.*?)</article>', 1) AS body FROM pages
), b AS (
    SELECT page_id, url, list_transform(
        regexp_split_to_array(regexp_replace(body, '(?is)<br[^>]*>', ' ', 'g'), '(?i)</?(?:p|h1|h2|ul|li|div)(?:\s[^>]*)?>'),
        lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '(?s)<[^>]*>', '', 'g'), '&lt;', '<'),
            '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM a
)
SELECT page_id, url, text, length(text) AS n_chars
FROM (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
"""


@query("op1_templates", PAGES_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_texts(table(spark, sf_dir, "pages"))


VECTORS_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
    SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
    WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND list_dot_product(e, e) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), reach AS (
    SELECT vec_id, vec_id AS other FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a
), c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT c.vec_id, COALESCE(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""


@query("op2_multi_index", VECTORS_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.linked(table(spark, sf_dir, "embeddings"))


@query("op3_token_files")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(table(spark, sf_dir, "documents"))


@query("op4_edit_counts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.edited_counts(table(spark, sf_dir, "documents"))


@query("op5_piece_lattice")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.encode_pieces(table(spark, sf_dir, "documents"))


JACCARD_SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.t = b.t AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id, doc_id AS other FROM sets
    UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a
)
SELECT sets.doc_id, len(s) AS n_shingles, c.component_id
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


@query("op6_jaccard_join", JACCARD_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


# Positions from the lengths between and of the matches; the structural kinds do not occur in the given tables.
_ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+)"""
_VALUE = r"""(?i:(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)"""
SECRETS_SQL = f"""
WITH texts AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
found AS (
    SELECT doc_id, 'assign' AS kind, 0 AS rank, 6 AS least, regexp_extract_all(t, '{_ASSIGN}') AS hits,
        regexp_extract_all(t, '{_VALUE}', 1) AS parts, regexp_split_to_array(t, '{_ASSIGN}') AS gaps FROM texts
    UNION ALL SELECT doc_id, 'access', 1, 20, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'),
        regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM texts
    UNION ALL SELECT doc_id, 'hex', 2, 24, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'),
        regexp_split_to_array(t, '[0-9a-f]+') FROM texts
), numbered AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found),
spans AS (
    SELECT doc_id, kind, rank, least, len(hits[i]) AS size, len(parts[i]) AS part,
        len(array_to_string(gaps[1:i], '')) + len(array_to_string(hits[1:i - 1], '')) AS s
    FROM numbered WHERE len(parts[i]) >= least
), joined AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s || ':' || (s + size), ',' ORDER BY s, rank) AS spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex,
    sha256(COALESCE(spans, '')) AS base_sha256, COALESCE(spans, '') AS spans
FROM documents d LEFT JOIN joined USING (doc_id)
"""


@query("op7_secrets", SECRETS_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def _record_bytes(page_id: str, body: str) -> str:
    head = f"""'WARC/1.0..WARC-Type: response..WARC-Record-ID: <urn:page:' || {page_id} || '>..WARC-Target-URI: '
        || COALESCE(url, '') || '..Content-Length: ' || strlen({body}) || '....'"""
    return f"strlen({head}) + strlen({body}) + 4"


FIXITY_SQL = f"""
WITH d AS (
    SELECT page_id, url, COALESCE(html, '') AS body, COALESCE(CASE WHEN page_id % 307 = 3 THEN NULL
        WHEN page_id % 101 = 7 THEN html[1:2] || '#' || html[4:] WHEN page_id % 211 = 5 THEN html[1:length(html) // 2] ELSE html END, '') AS found,
        row_number() OVER (ORDER BY page_id) - 1 AS n FROM pages
), r AS (
    SELECT page_id, n, n // 1024 AS file_no, {_record_bytes("page_id", "body")} AS n_bytes,
        CASE WHEN page_id % 307 = 3 THEN 0 ELSE {_record_bytes("page_id", "found")} END AS found_bytes,
        CASE WHEN page_id % 401 = 9 THEN {_record_bytes("(-page_id - 1)", "body")} ELSE 0 END AS added_bytes FROM d
), f AS (
    SELECT *, COALESCE(sum(n_bytes) OVER before, 0) AS record_offset,
        sum(found_bytes) OVER (PARTITION BY file_no) + COALESCE(sum(added_bytes) OVER before, 0) AS added_offset,
        COALESCE(max(CASE WHEN page_id % 307 = 3 OR (page_id % 211 = 5 AND page_id % 101 <> 7) THEN 1 ELSE 0 END)
            OVER before, 0) AS shifted
    FROM r WINDOW before AS (PARTITION BY file_no ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT page_id, CAST(file_no AS BIGINT) AS file_no, CAST(record_offset AS BIGINT) AS record_offset, n_bytes,
    CASE WHEN page_id % 307 = 3 THEN 'missing' WHEN page_id % 101 = 7 OR page_id % 211 = 5 THEN 'changed'
        WHEN shifted = 1 THEN 'moved' ELSE 'same' END AS status FROM f
UNION ALL SELECT -page_id - 1, CAST(file_no AS BIGINT), CAST(added_offset AS BIGINT), added_bytes, 'extra' FROM f WHERE added_bytes > 0
"""


@query("op8_fixity", FIXITY_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.replica_audit(table(spark, sf_dir, "pages"))


@query("op9_toxicity")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Every planted passage of the given tables is unchanged but for case and white space.
PASSAGES_SQL = r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(lower(COALESCE(text, '')), '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM documents),
b AS (SELECT item_id, trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM benchmark WHERE text IS NOT NULL)
SELECT doc_id, item_id, 0 AS edits, CAST(strlen(d.t[1:instr(d.t, b.t) - 1]) AS BIGINT) AS start
FROM d, b WHERE b.t <> '' AND contains(d.t, b.t)
"""


@query("op10_decontaminate", PASSAGES_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ROUND = """
a{0} AS (SELECT n, min(struct_pack(d := d, c := c)) AS near FROM (
    SELECT v.n, c.c, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM v, c{0} c) GROUP BY n),
"""
_MOVE = """
m{1} AS (SELECT c, list(total // members - CASE WHEN total % members < 0 THEN 1 ELSE 0 END ORDER BY i) AS x FROM (
    SELECT c, i, CAST(sum(x[i]) AS BIGINT) AS total, count(*) AS members
    FROM (SELECT a.near.c AS c, v.x, unnest(range(1, 65)) AS i FROM a{0} a JOIN v USING (n)) GROUP BY c, i) GROUP BY c),
c{1} AS (SELECT c, COALESCE(m{1}.x, c{0}.x) AS x FROM c{0} LEFT JOIN m{1} USING (c)),
"""
# Integer division of a negative total goes towards zero, the floor one further where there is a rest.
CENTROID_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS n, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS x
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
    SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS INT) AS c, x FROM v
    QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) <= 16
),""" + "".join(_ROUND.format(i) + _MOVE.format(i, i + 1) for i in range(simplex_clusters.ROUNDS)) \
    + _ROUND.format(simplex_clusters.ROUNDS) + """
t AS (SELECT near.c AS c, CAST(sum(near.d) AS BIGINT) AS total FROM a3 GROUP BY near.c)
SELECT v.vec_id, near.c AS cluster, near.d AS distance, total AS cluster_inertia,
    (SELECT CAST(sum(total) AS BIGINT) FROM t) AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a3 JOIN v USING (n) JOIN t ON t.c = near.c JOIN c3 ON c3.c = near.c
"""


@query("op11_centroids", CENTROID_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex_clusters.clusters(table(spark, sf_dir, "embeddings")).drop("n_compared")


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


LINES_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS n, doc_id, COALESCE(text, '') AS text FROM documents),
w AS (SELECT n, list_filter(regexp_split_to_array(text, '{line_rules.WHITE}+'), lambda x: x <> '') AS w FROM t),
windows AS (SELECT n, i, array_to_string(w[i:i + {line_rules.WINDOW - 1}], ' ') AS s
    FROM (SELECT n, w, unnest(range(1, len(w) - {line_rules.WINDOW - 2})) AS i FROM w)),
twice AS (SELECT n, i FROM windows QUALIFY count(*) OVER (PARTITION BY n, s) > 1),
repeated AS (SELECT n, count(DISTINCT p) AS repeats FROM (SELECT n, unnest(range(i, i + {line_rules.WINDOW})) AS p FROM twice) GROUP BY n),
lines AS (SELECT n, line, list_filter(regexp_split_to_array(line, '{line_rules.WHITE}+'), lambda x: x <> '') AS inside
    FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM t)),
judged AS (
    SELECT n, line, len(inside) AS size, len(list_filter(inside, lambda x: regexp_full_match(x, '[{re.escape(line_rules.SEPARATORS)}]+'))) AS marks,
        NOT regexp_matches(line, '{_quoted(line_rules.SENTENCE_END)}')
            OR 3 * len(regexp_extract_all(line, '{line_rules.ORNATE_END}')) > len(inside) AS unmarked,
        regexp_matches(lower(line), '{'|'.join(line_rules.PHRASES)}') AS phrased
    FROM lines WHERE len(inside) > 0
), per AS (
    SELECT n, count(*) - count(DISTINCT line) AS doubles, count(*) FILTER (fails) AS gone, COALESCE(sum(size) FILTER (fails), 0) AS lost
    FROM (SELECT *, unmarked OR (marks >= 2 AND 4 * marks >= size) OR (size <= {line_rules.BOILERPLATE_WORDS} AND phrased) AS fails FROM judged)
    GROUP BY n
), m AS (
    SELECT doc_id, len(w) AS n_words, CAST(COALESCE(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^{re.escape(line_rules.SYMBOLS)}]', '', 'g')) AS BIGINT) AS n_symbols,
        COALESCE(doubles, 0) AS n_dup_lines, COALESCE(repeats, 0) AS n_repeat_words,
        COALESCE(gone, 0) AS n_lines_removed, CAST(COALESCE(lost, 0) AS BIGINT) AS n_words_removed
    FROM t JOIN w USING (n) LEFT JOIN repeated USING (n) LEFT JOIN per USING (n)
)
SELECT *, n_words < {line_rules.LEAST_WORDS} OR 100 * n_repeat_words > {line_rules.REPEATED} * n_words AS base_failed,
    NOT (n_words < {line_rules.LEAST_WORDS} OR 100 * n_repeat_words > {line_rules.REPEATED} * n_words)
        AND 100 * n_words_removed <= {line_rules.LOST} * n_words AS kept
FROM m
"""


@query("op12_line_rules", LINES_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_verdicts(table(spark, sf_dir, "documents"))


@query("op13_runs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
