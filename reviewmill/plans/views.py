"""SQL text of the review views, used only to state the expected results."""

from __future__ import annotations

REVIEWS = r"""
reviews AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS record_id, d.doc_id AS source_row,
    CASE d.doc_id % 4 WHEN 0 THEN 'google_play' WHEN 1 THEN 'app_store' WHEN 2 THEN 'x' ELSE 'youtube' END AS platform,
    CASE WHEN d.doc_id % 4 < 2 THEN CAST(1 + CAST(FLOOR(d.doc_id / 4.0) AS BIGINT) % 5 AS INT) END AS rating,
    d.text, CASE WHEN d.doc_id % 4 < 2 THEN d.source END AS title,
    d.lang AS language, d.source AS app_id,
    CASE WHEN d.doc_id % 4 < 2 THEN 'MX' END AS country,
    CASE d.doc_id % 4 WHEN 0 THEN 'play' WHEN 1 THEN 'apple_rss' WHEN 2 THEN 'x' ELSE 'youtube' END AS preferred_provider,
    regexp_replace(d.text, '^[\s\x1c-\x1f\x0b\x{85}\x{a0}\p{Z}]+|[\s\x1c-\x1f\x0b\x{85}\x{a0}\p{Z}]+$', '', 'g') AS model_text,
    e.ts AS record_ts, strftime(e.ts, '%Y-%m') AS month,
    CASE l.quality WHEN 1 THEN 'human_relevant' WHEN 0 THEN 'human_irrelevant' ELSE 'unreviewed' END AS relevance,
    coalesce(CASE WHEN v.label = 9 THEN -1 ELSE v.label END, -1) AS cluster_id,
    round(CAST((d.doc_id * 37) % 101 AS DOUBLE) / 100, 2) AS probability,
    CAST(d.doc_id * 7 % 11 + 1 AS DOUBLE) / (d.doc_id * 7 % 11 + d.doc_id * 5 % 13 + d.doc_id * 3 % 17 + 3) AS p_negative,
    CAST(d.doc_id * 5 % 13 + 1 AS DOUBLE) / (d.doc_id * 7 % 11 + d.doc_id * 5 % 13 + d.doc_id * 3 % 17 + 3) AS p_neutral,
    CAST(d.doc_id * 3 % 17 + 1 AS DOUBLE) / (d.doc_id * 7 % 11 + d.doc_id * 5 % 13 + d.doc_id * 3 % 17 + 3) AS p_positive,
    CASE WHEN d.doc_id * 7 % 11 >= d.doc_id * 5 % 13 AND d.doc_id * 7 % 11 >= d.doc_id * 3 % 17 THEN 'negative'
         WHEN d.doc_id * 5 % 13 >= d.doc_id * 3 % 17 THEN 'neutral' ELSE 'positive' END AS sentiment
  FROM documents d
  LEFT JOIN events e ON e.event_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN embeddings v ON v.vec_id = d.doc_id
)"""

RAW = REVIEWS + r""",
raw AS (
  SELECT record_id, source_row, platform, app_id, country, text, title, rating,
    CASE WHEN source_row % 3 = 1 THEN strftime(record_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'
         ELSE strftime(record_ts, '%Y-%m-%d') END AS record_date,
    'source_updated_at' AS date_basis,
    CASE WHEN record_ts IS NULL THEN 'unknown' WHEN source_row % 3 < 2 THEN 'second' ELSE 'day' END AS date_precision,
    'UTC' AS date_timezone, strftime(record_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS updated_at,
    language, 'detected' AS language_basis, relevance, preferred_provider, 'provider_identity' AS identity_basis, model_text
  FROM reviews
)"""

PREPARED = RAW + r""",
prepared AS (
  SELECT record_id, platform, app_id, country, text, title, model_text, sha256(model_text) AS text_hash, rating,
    CASE WHEN date_precision = 'second' THEN updated_at ELSE record_date END AS record_date,
    date_basis, date_precision, date_timezone, language, language_basis, relevance, preferred_provider, identity_basis
  FROM raw WHERE model_text <> ''
)"""

OBSERVATIONS = r"""
observations AS (
  SELECT event_id AS batch_order, CASE WHEN user_id % 2 = 0 THEN 'play' ELSE 'apple_rss' END AS provider,
    'app' || CAST(user_id % 3 AS VARCHAR) AS app_id, CAST(user_id AS VARCHAR) AS source_id, 'mx' AS country,
    event_type AS text, CAST(user_id % 5 + 1 AS INT) AS rating, '1.0' AS app_version,
    CAST(CASE WHEN event_id % 7 = 3 THEN date_trunc('day', ts) - INTERVAL 3 DAY ELSE date_trunc('day', ts) END AS TIMESTAMP) AS updated_at, ts AS fetched_at
  FROM events
)"""


def over(view: str, body: str) -> str:
    """``body`` with a view in front; a body that starts with a comma adds more views."""
    body = body.strip()
    joiner = "" if body.startswith(",") else "\n"
    return f"WITH {view.strip()}{joiner}{body}"
