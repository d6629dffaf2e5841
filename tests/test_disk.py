"""What jobs leave on disk while they run."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import id_marks, jaccard_join
from reviewmill.operators import blocks as B
from reviewmill.operators import topics as K
from reviewmill.session import discard, shared_folder, stored


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {file for file in (files.apply(at).getName() for at in range(files.size())) if file.startswith("shuffle")}


def written(spark):
    folder = shared_folder(spark)
    return {name.rsplit("-", 1)[0] + "/" + name for name in os.listdir(folder.removeprefix("file://"))}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    kept = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "few-counts")
    assert shuffle_files(spark) <= before
    assert sorted(r["k"] for r in kept.collect()) == list(range(7))
    discard(kept)
    assert not any("few-counts/" in name for name in written(spark))


@pytest.mark.parametrize("ids", [[], [3], [3, 5, 8, 99], list(range(40))])
def test_rows_by_their_ids(spark, ids):
    rows = spark.createDataFrame([(None if i == 7 else i % 30, f"text {i}") for i in range(45)], "doc_id long, text string")
    listed = stored(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    got, rest = (sorted(r["text"] for r in way(rows, listed, "doc_id").collect()) for way in (id_marks.rows_of, id_marks.rows_without))
    assert got == sorted(f"text {i}" for i in range(45) if i != 7 and i % 30 in ids)
    assert rest == sorted(f"text {i}" for i in range(45) if i == 7 or i % 30 not in ids)


def test_only_the_texts_of_pairs_are_shuffled(spark, tmp_path):
    texts = stored(spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 20).alias("text")), "texts")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        # The first shuffle on the side of the texts is behind the test of their bits.
        plan = id_marks.rows_of(texts, wanted, "doc_id")._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Exchange hashpartitioning(doc_id") < plan.index("_bits") < plan.index("BroadcastExchange")
        found = jaccard_join.texts_of(pairs, texts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 2, 3]


def test_the_join_keeps_no_texts_and_prefixes(spark):
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(words[:59] + [f"x{i}"])) for i in range(5)] + [(9, "some other words that stand alone here")]
    before = written(spark)
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 9}
    left = {name.split("/")[0] for name in written(spark) - before}
    assert not left & {"pair-texts", "crowd-texts", "shared-prefixes", "shared-classes", "open-shingles"}


@pytest.mark.parametrize("words", [100])
def test_leading_terms_are_kept_in_the_buckets(spark, monkeypatch, words):
    monkeypatch.setattr(K, "WORDS_A_BUCKET", words)
    # Many terms with equal counts, so that ties are cut in order of the terms.
    texts = [(i % 3, i, f"app falla tarda w{i % 5} x{i} x{i} z{i % 2} ünder w{i % 7}") for i in range(30)] + [(0, 70, None), (2, 71, "")]
    rows = spark.createDataFrame(texts, "topic_id int, source_row bigint, text string")
    plain, products = K.scored_terms(rows)
    plain = stored(plain)
    before = written(spark)
    weights, lengths, sums = K.leading_scores(rows, 4)
    listed = lambda df: sorted((*r[:2], *(round(x, 9) for x in r[2:])) for r in df.collect())
    columns = ["topic_id", "rank", "tf", "words", "f", "idf", "weight"]
    for k in (1, 4):
        assert listed(K.keywords(weights, k).select(*columns)) == listed(K.keywords(plain, k).select(*columns))
        assert sorted((r["topic_id"], r["rank"], r["term"]) for r in K.keywords(weights, k).collect()) == sorted(
            (r["topic_id"], r["rank"], r["term"]) for r in K.keywords(plain, k).collect())
    assert listed(K.review_scores(sums, lengths)) == listed(K.review_scores(products, plain))
    assert weights.count() < plain.count()
    left = {name.split("/")[0] for name in written(spark) - before}
    assert not left & {"words", "borders", "products"}
    assert [t.isEmpty() for t in K.leading_scores(rows.limit(0), 4)] == [True] * 3


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_rows_meet_in_few_large_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(B, "ROWS_PER_PIVOT", 8)
    monkeypatch.setattr(B, "NEAREST_ROWS", 64)
    monkeypatch.setattr(B, "BLOCK_ROWS", 16)
    cells = []
    monkeypatch.setattr(B, "meet", lambda left, *rest, run=B.meet: cells.append(len(left.cells)) or run(left, *rest))
    points = np.random.default_rng(5).normal(size=(400, 6))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    got = {(r["id"], r["rank"]): r["neighbour"] for r in B.nearest(
        spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>"), "id", "vector", 3, metric).collect()}
    score = points @ points.T
    np.fill_diagonal(score, -2)
    order = np.argsort(-score, axis=1)
    # Of unit vectors, the nearest by distance are those by product.
    assert got == {(i, rank + 1): int(order[i, rank]) for i in range(400) for rank in range(3)}
    assert cells and cells[0] <= 8
