"""Nearest neighbours, density groups and ordered helpers against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewmill.operators import blocks as B
from reviewmill.operators import clusters as C
from reviewmill.operators import features as Fe
from reviewmill.operators import neighbours as N
from reviewmill.operators.components import connected_components
from reviewmill.operators.ordered import after, before, numbered, with_blocks
from reviewmill.operators import boxes, lists, quantile
from reviewmill.operators.quantile import exact_quantile


def unit(rng, rows, dims):
    points = rng.normal(size=(rows, dims))
    return (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)


def table(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id bigint, vector array<float>")


def brute(points, k, euclidean=False):
    p = points.astype(np.float64)
    score = np.round(-np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) if euclidean else p @ p.T, 9)
    out = {}
    for i in range(len(p)):
        order = [j for j in np.lexsort((np.arange(len(p)), -score[i])) if j != i][:k]
        out[i] = [round(abs(float(score[i, j])), 6) for j in order]
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_with_copies_and_small_blocks(spark, metric):
    rng = np.random.default_rng(3)
    centres = unit(rng, 6, 8)
    points = unit(rng, 120, 8) * 0.15 + centres[rng.integers(0, 6, 120)]
    points = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)
    points[40:80] = points[0]  # a third of all rows are copies of one
    got = B.nearest(table(spark, points), "id", "vector", 5, metric, block_rows=16, pivots=9).collect()
    lists = {}
    for r in sorted(got, key=lambda r: (r["id"], r["rank"])):
        lists.setdefault(r["id"], []).append(round(abs(r["score"]), 6))
        assert r["id"] != r["neighbour"]
    expected = brute(points, 5, metric == "euclidean")
    assert set(lists) == set(expected)
    for i in expected:
        np.testing.assert_allclose(lists[i], expected[i], atol=2e-6)
    copies = {r["neighbour"] for r in got if r["id"] == 40}
    assert copies == {0, 41, 42, 43, 44}


def clustered(size, seed):
    rng = np.random.default_rng(seed)
    middles = unit(rng, 12, 16)
    points = middles[rng.integers(0, 12, size)] + 0.5 * unit(rng, size, 16)
    points = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)
    points[size // 3:size // 2] = points[0]  # copies of one vector
    return points


@pytest.mark.parametrize("tile", [4096, 8])
def test_lists_answer_every_query_whole(spark, monkeypatch, tile):
    monkeypatch.setattr(lists, "TILE", tile)
    points = clustered(600, 3)
    vectors = table(spark, points)
    queries = vectors.where("id % 50 = 0").select("id")
    found = lists.nearest_in_lists(vectors, "id", "vector", 5, 1, queries, lists=80).collect()
    by_query = {}
    for row in found:
        by_query.setdefault(row["id"], []).append(row)
    assert set(by_query) == set(range(0, 600, 50))
    for query, rows in by_query.items():
        assert sorted(row["rank"] for row in rows) == [1, 2, 3, 4, 5] and len({row["neighbour"] for row in rows}) == 5
        assert query not in {row["neighbour"] for row in rows}
        for row in rows:  # scores are exact whatever was visited
            assert row["score"] == pytest.approx(float(points[query].astype(float) @ points[row["neighbour"]].astype(float)))


def test_lists_recall(spark):
    points = clustered(1500, 4)
    vectors = table(spark, points)
    exact = B.nearest(vectors, "id", "vector", 5)
    index = lists.built(vectors.selectExpr("id as rep", "vector").dropDuplicates(["vector"]))
    assert 20 <= len(index[1].second) <= 60 and index[2].sum() == len(np.unique(points, axis=0))
    assert N.recall(exact, lists.nearest_in_lists(vectors, "id", "vector", 5, probe=8)).first()["recall"] >= 0.95
    with pytest.raises(ValueError):
        lists.nearest_in_lists(vectors.limit(0), "id", "vector")


def test_cells_out_of_reach_are_skipped(spark):
    rng = np.random.default_rng(5)
    near, far = unit(rng, 1, 4), -unit(rng, 1, 4)
    points = np.vstack([near + 0.001 * rng.normal(size=(50, 4)), far + 0.001 * rng.normal(size=(50, 4))]).astype(np.float32)
    index = B.blocked(table(spark, points), "id", "vector", 16, 8)
    assert len(index.near_cells(index.nearest_bound(5))) < len(index.all_cells())


def brute_density(points, reach, least, smallest):
    p = points.astype(np.float64)
    gap = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    core = (gap <= reach).sum(1) >= least
    label = np.full(len(p), -1)
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], i
            while stack:
                a = stack.pop()
                for b in np.nonzero(core & (gap[a] <= reach) & (label < 0))[0]:
                    label[b] = i
                    stack.append(b)
    result = label.copy()
    for i in np.nonzero(~core)[0]:
        options = [(gap[i, j], j) for j in np.nonzero(core)[0] if gap[i, j] <= reach]
        result[i] = label[min(options)[1]] if options else -1
    return sorted(frozenset(np.nonzero(result == c)[0].tolist()) for c in set(result) - {-1} if (result == c).sum() >= smallest)


@pytest.mark.parametrize("seed", [1, 2])
def test_density_groups_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    points = np.vstack([rng.normal(c, 0.06, size=(40, 2)) for c in (0, 1, 2.5)] + [rng.uniform(-1, 4, size=(30, 2))]).astype(np.float32)
    points[5:45] = points[5]
    got = C.density_clusters(table(spark, points), 5, 3, 0.08)
    groups = {}
    for r in got.collect():
        assert 0.0 <= r["probability"] <= 1.0
        if r["cluster_id"] >= 0:
            groups.setdefault(r["cluster_id"], set()).add(r["id"])
    assert got.count() == len(points)
    assert {frozenset(g) for g in groups.values()} == set(brute_density(points, 0.08, 3, 5))
    sizes = [len(groups[i]) for i in sorted(groups)]
    assert sizes == sorted(sizes, reverse=True)


@pytest.mark.parametrize("dims", [2, 20])
def test_gaps_of_rows_in_many_boxes(spark, monkeypatch, dims):
    rng = np.random.default_rng(dims)
    points = np.vstack([rng.normal(c, 0.1, size=(90, dims)) for c in (0, 1)] + [rng.uniform(-9, 9, size=(20, dims))]).astype(np.float32)
    often = rng.integers(1, 4, len(points))
    unique = spark.createDataFrame([(i, [float(x) for x in p], int(c)) for i, (p, c) in enumerate(zip(points, often))], "id bigint, vector array<float>, copies bigint")
    monkeypatch.setattr(boxes, "VISITORS", 7)
    got = {r["id"]: r["gaps"] for r in boxes.nearest_gaps(unique, 5, 16).collect()}
    p = points.astype(np.float64)
    gap = np.repeat(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)), often, axis=1)
    assert set(got) == set(range(len(points)))
    for i in got:
        np.testing.assert_allclose(got[i], np.sort(gap[i])[:5], atol=1e-9)
    few = boxes.nearest_gaps(unique.limit(1), 5).first()["gaps"]
    assert few == [0.0] * int(often[0])


def test_density_groups_over_many_boxes(spark, monkeypatch):
    monkeypatch.setattr(boxes, "BOX_ROWS", 8)
    monkeypatch.setattr(boxes, "VISITORS", 5)
    test_density_groups_match_brute_force(spark, 3)


def test_a_row_visits_only_boxes_within_its_reach(spark):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(4000, 2)).astype(np.float32)
    index = boxes.boxed(table(spark, points), 64)
    assert index.rows.select("box").distinct().count() == 64 and index.rows.groupBy("box").count().agg(F.max("count")).first()[0] < 300
    sent = boxes.visits(index, index.rows, F.lit(0.05))
    assert 4000 < sent.count() < 4000 * 8
    # No pair within the reach is lost.
    p, box = points.astype(np.float64), {r["id"]: r["box"] for r in index.rows.collect()}
    seen = {(r["id"], r["box"]) for r in sent.collect()}
    near = np.argwhere(np.sqrt(((p[:400, None] - p[None]) ** 2).sum(-1)) <= 0.05)
    assert len(near) > 1000 and all((int(a), box[int(b)]) in seen for a, b in near)
    onward = {(r["id"], r["box"]) for r in boxes.visits(index, index.rows, F.lit(0.05), onward=True).collect()}
    assert onward == {(i, b) for i, b in seen if b >= box[i]}


def test_sweep_matches_single_runs(spark):
    rng = np.random.default_rng(7)
    points = table(spark, np.vstack([rng.normal(c, 0.1, size=(30, 2)) for c in (0, 2)]).astype(np.float32))
    sweep = {(r["min_cluster_size"], r["min_samples"]): (r["groups"], r["unassigned"], r["largest_group"]) for r in C.cluster_sweep(points, (5, 10), (1, 3), 0.1).collect()}
    for (size, least), expected in sweep.items():
        rows = [r["cluster_id"] for r in C.density_clusters(points, size, least, 0.1).collect()]
        kept = [rows.count(c) for c in set(rows) - {-1}]
        assert expected == (len(kept), rows.count(-1), max(kept, default=0))


def test_divergent_pair(spark):
    rows = spark.createDataFrame(
        [(0, [1.0, 0.0, 0.0], "Good app!"), (1, [1.0, 0.0, 0.0], "good  APP"), (2, [0.98, 0.199, 0.0], "fine"), (3, [0.0, 0.0, 1.0], "bad")],
        "id bigint, vector array<float>, text string")
    best = N.divergent_pair(rows, "id", "vector", "text", 0.9).first()
    assert (best["a"], best["b"]) == (0, 2) and len(best["far_dimensions"]) == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 102, 200]], "node int")
    got = {r["node"]: r["component"] for r in connected_components(nodes, spark.createDataFrame(edges, "a int, b int")).collect()}
    assert set(got[i] for i in range(41)) == {0} and {got[100], got[101], got[102]} == {100} and got[200] == 200


@pytest.mark.parametrize("width", [3, 1000])
def test_carried_values(spark, width):
    rng = np.random.default_rng(2)
    rows = [(int(g), i, int(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 50, 60)))]
    df = with_blocks(spark.createDataFrame(rows, "g int, i bigint, v int"), "i", width)
    got = after(before(df, ["g"], "i", {"most": F.col("v")}), ["g"], "i", {"following": F.struct("i", "v")}).collect()
    assert len(got) == 60
    for r in got:
        earlier = [v for g, i, v in rows if g == r["g"] and i < r["i"]]
        later = [(i, v) for g, i, v in rows if g == r["g"] and i > r["i"]]
        assert r["most"] == (max(earlier) if earlier else None)
        assert (tuple(r["following"]) if r["following"] else None) == (later[0] if later else None)


def test_numbered_is_dense_and_ordered(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1009).alias("k")).repartition(5)
    got = sorted((r["position"], r["k"]) for r in numbered(df, ["k"]).collect())
    assert [p for p, _ in got] == list(range(500)) and [k for _, k in got] == sorted(k for _, k in got)


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.995, 1.0])
def test_exact_quantile(spark, share):
    values = np.concatenate([np.random.default_rng(4).normal(size=301), np.zeros(150)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert exact_quantile(df, "v", share).first()[0] == pytest.approx(np.quantile(values, share), abs=1e-12)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.7, 0.9999, 1.0])
@pytest.mark.parametrize("kind", ["heavy tail", "two values", "ties around a crowd", "one value"])
def test_quantiles_of_uneven_values(spark, monkeypatch, kind, share):
    """Equal-width bins would put nearly all of these into one bin."""
    monkeypatch.setattr(quantile, "FEW", 50)
    random = np.random.default_rng(7)
    values = {
        "heavy tail": np.concatenate([random.pareto(0.3, 6000), [1e300, -1e200]]),
        "two values": np.repeat([1.0, 2.0], [4200, 1801]),
        "ties around a crowd": np.concatenate([np.full(2950, -1e9), random.normal(size=200), np.full(2850, 1e9)]),
        "one value": np.full(500, 3.5),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"v": random.permutation(values)})).repartition(4)
    assert exact_quantile(df, "v", share).first()[0] == pytest.approx(np.quantile(values, share), rel=1e-12)


def test_quantile_of_nothing(spark):
    assert exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5).first()[0] is None


def test_cold_and_warm_encoding(spark):
    texts = ["palabra " * 200, "dos", "tres cuatro cinco seis", "palabra " * 200]
    featured = Fe.features(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "record_id string, model_text string"))
    empty = spark.createDataFrame([], "encoder_id string, input_hash string, vector array<float>, tokens int")
    rows, fresh = Fe.encode_reviews(featured, empty, "e", Fe.bag_encoder(16))
    rows, fresh = rows.cache(), fresh.cache()
    cold = Fe.encoding_report(rows).first()
    assert (cold["rows"], cold["unique_texts"], cold["encoded_unique"], cold["reused_unique"]) == (4, 3, 3, 0)
    assert (cold["truncated_unique"], cold["truncated_rows"]) == (1, 2)
    warm = Fe.encoding_report(Fe.encode_reviews(featured, fresh, "e", Fe.bag_encoder(16))[0]).first()
    assert (warm["encoded_unique"], warm["reused_unique"]) == (0, 3)
    other = Fe.encoding_report(Fe.encode_reviews(featured, fresh, "other", Fe.bag_encoder(16))[0]).first()
    assert other["encoded_unique"] == 3
    check = Fe.vector_validation(rows, "vector", 16).first()
    assert (check["wrong_size"], check["nonfinite"], check["not_unit"]) == (0, 0, 0)


def test_validation_sees_all_rows(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), (" ", "z"), ("b", "\t")], "record_id string, model_text string")
    got = Fe.validate_reviews(rows).first()
    assert (got["rows"], got["invalid_id_rows"], got["duplicate_id_rows"], got["invalid_text_rows"], got["valid"]) == (4, 1, 2, 1, False)
    with pytest.raises(ValueError):
        Fe.pin_selection(rows.withColumn("vector_row", F.lit(1)), ["record_id"])


def test_silhouette_forms(spark):
    rng = np.random.default_rng(9)
    points = np.vstack([rng.normal(0, 0.1, (20, 3)), rng.normal(2, 0.1, (25, 3))])
    rows = spark.createDataFrame([(i, [float(x) for x in p], int(i >= 20)) for i, p in enumerate(points)], "id bigint, vector array<double>, cluster_id int")
    for power, job in ((1, C.silhouette_euclidean), (2, C.silhouette_squared)):
        gap = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) ** power
        own = np.arange(45) >= 20
        a = np.array([gap[i, own == own[i]].sum() / ((own == own[i]).sum() - 1) for i in range(45)])
        b = np.array([gap[i, own != own[i]].mean() for i in range(45)])
        assert job(rows).first()["silhouette"] == pytest.approx(np.mean((b - a) / np.maximum(a, b)), abs=1e-6)
