"""Preparation, text, intake, topics, evidence, sentiment, models and reports on small fixtures."""

import hashlib
import hmac
import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill import schemas as S
from reviewmill.functions import dates as D
from reviewmill.functions import text as X
from reviewmill.functions.hashing import author_pseudonym, canonical_json, ordered_digest, text_hash
from reviewmill.functions.numbers import wilson_low
from reviewmill.operators import evidence as Ev
from reviewmill.operators import explore as E
from reviewmill.operators import mart as M
from reviewmill.operators import models as L
from reviewmill.operators import prepare as P
from reviewmill.operators import sentiment as Se
from reviewmill.operators import topics as K
from reviewmill.operators.postings import _hits, bucket_counts, bucket_postings, postings, review_sums, summed_counts, summed_products, term_bucket, term_counts
from reviewmill.sources import pages, release, scalars

STAMP = "2026-09-10T12:00:00+00:00"
RAW = [c for c in S.PREPARED_COLUMNS if c not in ("model_text", "text_hash")] + ["updated_at", "published_at"]


def raw(spark, *changes):
    base = dict(platform="google_play", app_id="a", country="MX", text="hola", title=None, rating=3, record_date=STAMP, date_basis="source_updated_at",
                date_precision="second", date_timezone="UTC", language=None, language_basis="not detected", relevance="app_target_match",
                preferred_provider="play", identity_basis="provider_identity", updated_at=STAMP, published_at=None)
    rows = [{**base, "record_id": f"r{i}", **change} for i, change in enumerate(changes)]
    schema = ", ".join(f"{c} {'int' if c == 'rating' else 'string'}" for c in RAW)
    return spark.createDataFrame([tuple(r[c] for c in RAW) for r in rows], schema)


def test_prepared_text_hash_and_exclusions(spark):
    rows = raw(spark, {"text": "  ¡Buen servicio!  ", "title": " Hola "}, {"text": "  \n"}, {"platform": "x", "language": "es"}, {"text": None})
    prepared = P.prepare_reviews(rows)
    assert prepared.data.columns == S.PREPARED_COLUMNS
    first = prepared.data.where("record_id = 'r0'").first()
    assert first["model_text"] == "¡Buen servicio!" and first["text_hash"] == hashlib.sha256("¡Buen servicio!".encode()).hexdigest()
    assert {r["record_id"]: r["reason"] for r in prepared.excluded.collect()} == {"r1": "blank_text", "r3": "blank_text"}
    total = prepared.report.where("platform = '(all)'").first()
    assert (total["input_count"], total["row_count"], total["excluded_count"]) == (4, 2, 2)
    titled = P.prepared_rows(rows, P.Rules(combine_title_body=True)).where("record_id = 'r0'").first()
    assert titled["model_text"] == "Hola\n¡Buen servicio!"


def test_reason_precedence_and_empty_lists(spark):
    rows = raw(spark, {"platform": "x", "text": " "}, {"platform": "x", "language": "fr"}, {"language": None}, {"language": "es", "relevance": "human_irrelevant"})
    rules = P.Rules(platforms=["google_play"], language_filter=["es"], relevance_filter=["human_relevant"])
    got = {r["record_id"]: r["reason"] for r in P.excluded_rows(rows, rules).collect()}
    assert got == {"r0": "blank_text", "r1": "platform_filter", "r2": "language_filter", "r3": "relevance_filter"}
    assert P.prepared_rows(rows, P.Rules(platforms=[])).count() == 0


@pytest.mark.parametrize("rules", [{"unknown": 1}, {"columns": ["a"]}, {"combine_title_body": 1}, {"platforms": ["web"]}, {"language_filter": "es"}])
def test_bad_rules_are_rejected(rules):
    with pytest.raises(ValueError):
        P.Rules.of(rules)


@pytest.mark.parametrize("change,rule", [
    ({"rating": 6}, "rating_out_of_range"), ({"record_date": None}, "date_missing_date"), ({"date_precision": "day"}, "date_not_a_day"),
    ({"record_date": "2026-09-10", "updated_at": "2026-09-10"}, "date_no_source_stamp"), ({"record_date": "2026-09-10T12:00:00"}, "date_timezone_mismatch"),
    ({"record_date": "2026-13-40", "date_precision": "day"}, "date_invalid_day"), ({"date_precision": "hour"}, "date_invalid_precision"),
    ({"relevance": "maybe"}, "invalid_relevance"), ({"text": " ", "record_date": None}, "date_missing_date"),
])
def test_broken_rows_fail(spark, change, rule):
    rows = raw(spark, change)
    assert rule in [r["rule"] for r in P.violations(rows).collect()]
    with pytest.raises(ValueError, match=rule):
        P.prepare_reviews(rows)


def test_excluded_rows_skip_value_checks_and_dates_recover(spark):
    rows = raw(spark, {"text": " ", "rating": 6}, {"record_date": "2026-09-10"}, {"record_date": None, "date_precision": "unknown"}, {"record_date": "2026-09-10 12:00:00Z"})
    assert P.violations(rows).count() == 0
    got = {r["record_id"]: (r["record_date"], r["date_recovered"]) for r in P.recover_dates(rows).collect()}
    assert got["r1"] == (STAMP, True) and got["r2"] == (None, False) and got["r3"] == (STAMP, False)


def test_months_are_counted_in_utc(spark):
    rows = spark.createDataFrame([("google_play", "2026-03-01T00:30:00+02:00"), ("app_store", "2026-01-31T23:30:00-02:00"), ("google_play", "2026-01-02"),
                                  (None, "not-a-date"), ("app_store", None)], "platform string, record_date string")
    got = {(r["kind"], r["name"]): r["rows"] for r in E.dataset_summary(rows).collect()}
    assert got == {("platform", "google_play"): 2, ("platform", "app_store"): 2, ("month", "2026-01"): 1, ("month", "2026-02"): 2, ("unknown_dates", ""): 2}
    assert rows.select(D.parse_utc(F.lit("2026"))).first()[0] is None


def test_tokens(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.words(F.lit("Straße NO_abre 2 veces: https://a.b/c más"))) == ["strasse", "no", "abre", "veces", "más"]
    assert one(X.words(F.lit("Café"), compose=True)) == ["café"]
    assert one(X.kept_terms(F.lit("La app no abre y es mala"))) == ["app", "no", "abre", "mala"]
    assert one(X.bigrams(F.array(F.lit("a")))) == [] and one(X.bigrams(F.array(*map(F.lit, "abc")))) == ["a b", "b c"]
    assert one(X.strip(F.lit("\x1f  a b\x1c\n"))) == "a b"
    assert one(X.plain_wording(F.lit(" ¡Qué MAL, app! "))) == "qué mal app"
    assert len(X.VECTORIZER_STOP_WORDS) == 31 and len(X.EXPLORATION_STOP_WORDS) == 110


def test_patterns(spark):
    rows = spark.createDataFrame([("bueeeno!!",), ("JAMÁS ÁPP",), ("cuesta $ 1,200.50 www.x.y",), ("😀 ok",), (None,)], "text string")
    got = {r["pattern"]: r["reviews"] for r in E.pattern_rates(rows).collect()}
    assert got == {"repeated_marks": 1, "upper_case": 1, "negations": 1, "emoji": 1, "links": 1, "amounts": 1, "repeated_letters": 2}


def test_digest_depends_on_order_boundaries_and_text(spark):
    digest = lambda rows: ordered_digest(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string"), "i", ["a", "b"]).first()["digest"]
    base = digest([("ab", "c"), ("x", "y")])
    assert base != digest([("a", "bc"), ("x", "y")]) and base != digest([("x", "y"), ("ab", "c")]) and base == digest([("ab", "c"), ("x", "y")])
    assert digest([("x", None)]) != digest([("x", "")])
    one = spark.range(1).select(canonical_json({"b": F.lit(None).cast("string"), "a": F.lit(1)})).first()[0]
    assert one == '{"a":1,"b":null}'


def test_author_pseudonym_is_an_hmac(spark):
    for salt in (b"secret", b"x" * 90):
        got = spark.range(1).select(author_pseudonym(F.lit("https://a/b/id42"), salt, "v1")).first()[0]
        assert got == "v1:" + hmac.new(salt, b"42", hashlib.sha256).hexdigest()


def test_feed_pages(spark):
    entry = lambda i, **k: {"id": {"label": i}, "updated": {"label": "2026-09-10T12:00:00Z"}, "content": {"label": "Synthetic review"}, "title": {"label": " "}, "im:rating": {"label": "2"}, **k}
    bodies = [{"feed": {"entry": entry("solo")}}, {"feed": {"entry": [{"im:name": {"label": "App"}}, entry("a"), entry("b")]}}, {"feed": {}}]
    rows = pages.parse_feed_pages(spark.createDataFrame([(json.dumps(b),) for b in bodies], "body string")).collect()
    assert sorted(r["source_id"] for r in rows) == ["a", "b", "solo"]
    assert all(r["title"] is None and r["rating"] == 2 and r["updated_at"].isoformat() == "2026-09-10T12:00:00" for r in rows)


@pytest.mark.parametrize("token", ["next", None])
def test_rpc_pages(spark, token):
    review = ["new", ["author"], 2, None, "Says \"hi\"\n", [1789041600], 0, None, None, None, "1.0"]
    body = ")]}'\n\n" + json.dumps([["wrb.fr", "oCPfdb", json.dumps([[review], [None, token], None])]])
    df = spark.createDataFrame([(body,)], "body string")
    row = pages.parse_rpc_pages(df).first()
    assert (row["source_id"], row["rating"], row["text"], row["app_version"]) == ("new", 2, "Says \"hi\"\n", "1.0")
    assert row["updated_at"].isoformat() == "2026-09-10T12:00:00"
    assert pages.continuation(df).first()["token"] == token


def test_mixed_scalars(spark):
    values = [("float", "1.0"), ("str", "unified-update-v1"), ("null", None), ("bool", "true"), ("int", "1"), ("str", "1"), ("float", "NaN"), ("pd.NA", None), ("float", "Infinity"), ("float", "-Infinity"), ("str", 'q"\\\n')]
    df = spark.createDataFrame(values, "tag string, value string").withColumn("text", scalars.encode_scalar(F.col("tag"), F.col("value")))
    back = df.withColumn("back", scalars.decode_scalar(F.col("text"))).collect()
    assert [tuple(r["back"]) for r in back] == values
    assert json.loads(back[4]["text"]) == ["int", 1] and json.loads(back[6]["text"]) == ["float", "nan"]
    with pytest.raises(Exception, match="invalid encoded scalar"):
        spark.range(1).select(scalars.decode_scalar(F.lit('["int","x"]'))).collect()


def test_release_is_verified_and_never_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1), ("a", 2)], "record_id string, n int")
    path = str(tmp_path / "r")
    assert release.write_release(rows, path).first()["row_count"] == 2
    assert release.verify_release(spark, path).first()["valid"]
    with pytest.raises(Exception):
        release.write_release(rows, path)
    rows.limit(1).write.mode("append").parquet(path + "/data")
    changed = release.verify_release(spark, path).first()
    assert not changed["files_ok"]
    assert not changed["valid"] and not changed["rows_ok"] and not changed["content_ok"] and changed["columns_ok"]


def test_publication_conflicts(spark):
    schema = "seq int, run_id string, artifact_id string, info string"
    stored = spark.createDataFrame([(1, "a", "x", "{}")], schema)
    fresh, conflicts = release.publish(stored, spark.createDataFrame([(2, "a", "x", "{}"), (3, "b", "y", "{}")], schema))
    assert [r["run_id"] for r in fresh.collect()] == ["b"] and conflicts.count() == 0
    assert release.publish(stored, spark.createDataFrame([(2, "a", "x", "{1}")], schema))[1].count() == 1
    fresh, conflicts = release.publish(stored, spark.createDataFrame([(2, "n", "x", "{1}"), (3, "n", "y", "{2}")], schema))
    assert [r["info"] for r in fresh.collect()] == ["{1}"] and [r["info"] for r in conflicts.collect()] == ["{2}"]
    assert release.resolve(stored, "none").count() == 0


def topic_table(spark, texts):
    return spark.createDataFrame([(i, str(i), t, g, 0.5) for i, (g, t) in enumerate(texts)], "source_row bigint, record_id string, text string, cluster_id int, probability double")


TEXTS = [(0, "no abre app"), (0, ""), (0, "app lenta"), (1, "excelente app"), (-1, "hola mundo"), (0, "no abre nunca"), (1, "excelente servicio")]


@pytest.mark.parametrize("width", [1, 1000])
def test_class_terms_and_weights_by_hand(spark, width):
    rows = K.with_topics(topic_table(spark, TEXTS))
    counts, words = {}, {}
    numbers = {0: 0, 1: 1, -1: -1}
    for group, topic in numbers.items():
        tokens = " ".join(t for g, t in TEXTS if g == group).split()
        counts[topic] = Counter(tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])])
        words[topic] = sum(counts[topic].values())
    got = K.class_terms(rows, width)
    assert {(r["topic_id"], r["term"]): r["tf"] for r in got.collect()} == {(t, w): c for t, bag in counts.items() for w, c in bag.items()}
    average = int(sum(words.values()) / len(words))
    for r in K.weighted_terms(got).collect():
        f = sum(bag[r["term"]] for bag in counts.values())
        assert r["weight"] == pytest.approx(math.sqrt(counts[r["topic_id"]][r["term"]] / words[r["topic_id"]]) * math.log(1 + average / f))


def test_representatives_evidence_and_copies(spark):
    rows = K.with_topics(topic_table(spark, TEXTS + [(0, "no abre app")] * 5))
    chosen = K.representatives(rows, K.weighted_terms(K.class_terms(rows)))
    first = chosen.where("topic_id = 0 AND rank = 1").first()["source_row"]
    assert first in (0, 5)
    evidence = Ev.topic_evidence(rows, chosen, reviews=6, characters=5).where("topic_id = 0").orderBy("rank").collect()
    assert [r["alias"] for r in evidence] == [f"e{i}" for i in range(1, 7)] and len({r["record_id"] for r in evidence}) == 6
    assert evidence[0]["excerpt"] == "no ab" and evidence[0]["truncated"]
    texts = [r["excerpt"] for r in Ev.distinct_evidence(rows, chosen).where("topic_id = 0").collect()]
    assert len(texts) == len(set(texts)) == 4


REPEATED = [(0, 1, "no abre la app no abre"), (0, 1, "app no abre"), (0, 2, None), (0, 3, "y"), (1, 4, "no abre bien"),
            (1, None, "abre bien"), (1, None, "bien bien bien"), (0, 5, "App_2 ñandú, app_2 ñandú")]


@pytest.mark.parametrize("most", [1, 4, 1 << 20])
def test_terms_counted_in_arrays_equal_terms_one_by_one(spark, most):
    rows = spark.createDataFrame(REPEATED, "topic_id int, source_row bigint, text string").coalesce(1)
    bag = lambda found: Counter({tuple(r)[:-1]: r["c"] for r in found.collect()})
    each = K.review_terms(rows)
    counted = term_counts(rows, most).groupBy("topic_id", "term").agg(F.sum("tf").alias("c"))
    assert bag(counted) == bag(each.groupBy("topic_id", "term").agg(F.count("*").alias("c")))
    hits = postings(rows, most).select("topic_id", "term", F.explode("hits").alias("h")).groupBy("topic_id", "h.source_row", "term").agg(F.sum("h.times").alias("c"))
    assert bag(hits) == bag(each.groupBy("topic_id", "source_row", "term").agg(F.count("*").alias("c")))
    # A topic's term is one row for all reviews that are counted together.
    if most > 100:
        assert postings(rows, most).groupBy("topic_id", "term").count().where("count > 1").count() == 0


def test_rows_of_one_number_are_one_review(spark):
    rows = spark.createDataFrame(REPEATED, "topic_id int, source_row bigint, text string")
    weights = K.weighted_terms(K.class_terms(rows.withColumn("source_row", F.monotonically_increasing_id()))).collect()
    weight = {(r["topic_id"], r["term"]): (r["idf"], r["weight"]) for r in weights}
    length = {t: math.sqrt(sum(w * w for (topic, _), (_, w) in weight.items() if topic == t)) for t in (0, 1)}
    table = spark.createDataFrame([(t, w, i, v) for (t, w), (i, v) in weight.items()], "topic_id int, term string, idf double, weight double")
    own = {}
    for r in K.review_terms(rows).collect():
        own.setdefault((r["topic_id"], r["source_row"]), Counter())[r["term"]] += 1
    got = {(r["topic_id"], r["source_row"]): r["score"] for r in K.review_scores(rows, table).collect()}
    assert got.keys() == own.keys()
    for (topic, row), bag in own.items():
        values = {term: math.sqrt(c) * weight[topic, term][0] for term, c in bag.items()}
        product = sum(v * weight[topic, term][1] for term, v in values.items())
        assert got[topic, row] == pytest.approx(product / (math.sqrt(sum(v * v for v in values.values())) * length[topic]))


def test_a_topics_terms_are_not_exploded_before_they_are_counted(spark):
    rows = spark.createDataFrame(REPEATED, "topic_id int, source_row bigint, text string")
    plan = K.class_terms(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("most", [4, 1 << 20])
@pytest.mark.parametrize("buckets", [1, 5])
def test_terms_summed_in_buckets_equal_terms_one_by_one(spark, most, buckets):
    rows = spark.createDataFrame(REPEATED, "topic_id int, source_row bigint, text string").coalesce(1)
    sent = bucket_counts(rows, buckets, most)
    own, whole = Counter(), Counter()
    for r in K.review_terms(rows).collect():
        own[r["topic_id"], r["term"]] += 1
        whole[r["term"]] += 1
    got = summed_counts(sent).collect()
    assert {(r["topic_id"], r["term"]): (r["tf"], r["f"]) for r in got} == {(t, w): (c, whole[w]) for (t, w), c in own.items()} and len(got) == len(own)
    each = sent.select("bucket", F.explode("terms").alias("term"))
    assert each.where(F.col("bucket") != term_bucket(F.col("term"), buckets)).isEmpty() and (buckets == 1 or each.select("bucket").distinct().count() > 1)


def test_words_cut_once_serve_counts_weights_and_representatives(spark):
    rows = K.with_topics(topic_table(spark, TEXTS + [(0, None), (0, "no abre app")]))
    worded = K.with_terms(rows)
    assert "text" not in worded.columns and K.with_terms(worded) is worded
    weights = K.weighted_terms(K.class_terms(worded, totals=True))
    plain = K.weighted_terms(K.class_terms(rows))
    rounded = lambda df: sorted((r["topic_id"], r["term"], r["tf"], r["f"], round(r["weight"], 9)) for r in df.collect())
    assert rounded(weights) == rounded(plain)
    # Counts that carry those of all topics meet no window over the terms.
    assert "Window" not in K.class_terms(worded, totals=True)._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    chosen = lambda df: sorted((r["topic_id"], r["rank"], r["source_row"]) for r in df.collect())
    assert chosen(K.representatives(worded, weights)) == chosen(K.representatives(rows, plain))


@pytest.mark.parametrize("words", [2, 1 << 20])
def test_weights_and_scores_out_of_the_same_buckets(spark, monkeypatch, words):
    monkeypatch.setattr(K, "WORDS_A_BUCKET", words)
    monkeypatch.setattr("reviewmill.operators.postings.REVIEWS_HELD", words)
    for rows in (K.with_topics(topic_table(spark, TEXTS + [(0, None), (0, "no abre app")])),
                 spark.createDataFrame(REPEATED, "topic_id int, source_row bigint, text string").where("source_row IS NOT NULL")):
        plain = K.weighted_terms(K.class_terms(rows))
        weights, products = K.scored_terms(rows)
        rounded = lambda df: sorted((*r[:2], *(round(x, 9) for x in r[2:])) for r in df.collect())
        columns = ["topic_id", "term", "tf", "words", "f", "idf", "weight"]
        assert rounded(weights.select(columns)) == rounded(plain.select(columns))
        assert rounded(K.review_scores(products, weights)) == rounded(K.review_scores(rows, plain))
        # No join on terms: the products are read as they were written.
        assert "Join" not in products._jdf.queryExecution().optimizedPlan().toString()
    empty = K.scored_terms(rows.limit(0))
    assert empty[0].isEmpty() and K.representatives(empty[1], empty[0]).isEmpty()


@pytest.mark.parametrize("held", [2, 1 << 22])
def test_a_task_passes_the_sums_of_many_reviews_on_in_one_row(spark, monkeypatch, held):
    monkeypatch.setattr("reviewmill.operators.postings.REVIEWS_HELD", held)
    rows = spark.range(600).selectExpr("cast(id % 3 as int) topic_id", "id * 50 source_row", "concat('app falla w', id % 7, ' w', id) text", "5L total").repartition(3)
    found = summed_products(bucket_postings(K.with_terms(rows).crossJoin(rows.select("total").limit(1)), 40), 100.0, 4, listed=False).cache()
    tasks = found.rdd.getNumPartitions()
    assert held == 2 or found.count() <= 5 * tasks
    assert found.where("term IS NOT NULL").isEmpty()
    sums = review_sums(found).collect()
    assert len([r for r in sums if r["part"] == -1]) == 3 and len({(r["topic_id"], r["source_row"]) for r in sums if r["part"] >= 0}) == 600
    assert len(sums) == 603 and len({r["part"] for r in sums}) == 5


def test_lengths_alone_give_the_same_scores(spark):
    for rows in (K.with_topics(topic_table(spark, TEXTS + [(0, None), (0, "no abre app")])),
                 spark.createDataFrame(REPEATED, "topic_id int, source_row bigint, text string").where("source_row IS NOT NULL")):
        scores = lambda one, two: sorted((*r[:2], round(r["score"], 9)) for r in K.review_scores(two, one).collect())
        lengths, products = K.scored_terms(rows, listed=False)
        assert lengths.columns == ["topic_id", "length"] and scores(lengths, products) == scores(*K.scored_terms(rows))
        assert scores(*K.scored_terms(rows.limit(0), listed=False)) == []


def test_hits_of_numbers_too_large_to_be_put_together():
    key, row = np.array([5, 3, 5, 3, 9, 5]), np.array([0, 0, 1, 0, 2, 1])
    plain = [x.tolist() for x in _hits(key, row)]
    assert plain == [[3, 5, 9], [0, 1, 3], [0, 0, 1, 2], [2, 1, 2, 1]]
    large = [x.tolist() for x in _hits(key + (1 << 62), row)]
    assert large == [[x + (1 << 62) for x in plain[0]], *plain[1:]]


def test_postings_of_wanted_terms_alone(spark):
    rows = spark.createDataFrame(REPEATED, "topic_id int, source_row bigint, text string").coalesce(1)
    wanted = ["abre", "no abre", "app_2 ñandú", "ñandú app_2", "bien no", "nunca", "nunca abre"]
    flat = lambda df: sorted((r["topic_id"], r["term"], sorted(map(str, r["hits"]))) for r in df.collect())
    chosen = postings(rows, only=wanted)
    assert flat(chosen) == flat(postings(rows).where(F.col("term").isin(wanted))) and chosen.count() == 6
    assert postings(rows, only=[]).isEmpty()


def test_few_terms_are_sorted_for_a_topics_first_ones(spark):
    table = spark.range(3000).selectExpr("cast(id % 2 as int) topic_id", "concat('w', id) term", "cast(id div 40 as double) weight", "id div 100 tf")
    table = table.unionByName(spark.createDataFrame([(7, "a", 1.0, 2), (7, "b", 1.0, 2)], "topic_id int, term string, weight double, tf bigint"))
    for by in ("weight", "tf"):
        plain = K.top_per_group(table, ["topic_id"], [F.desc(by), F.asc("term")], 10)
        assert sorted(map(tuple, K.leading_terms(table, by, 10).collect())) == sorted(map(tuple, plain.collect()))
    assert K.contenders(table, "weight", 10).count() < 300


def test_fitting_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    schema = "target int, vector array<double>"
    rows = spark.createDataFrame([(i % 2, [float(i % 2) + i / 100, 1.0 - i / 50]) for i in range(20)], schema).mapInPandas(count, schema)
    model = L.fit_relevance(rows, "svm")
    assert seen.value == 20 and len(model.stages) == 2


def test_diverse_keywords_avoid_near_copies(spark):
    found = spark.createDataFrame([(0, "a", 0.9, [1.0, 0.0]), (0, "a2", 0.89, [0.99, 0.01]), (0, "b", 0.5, [0.0, 1.0])], "topic_id int, term string, similarity double, term_vector array<double>")
    order = lambda d: [r["term"] for r in K.diverse_keywords(found, d, 2).orderBy("rank").collect()]
    assert order(0.0) == ["a", "a2"] and order(0.7) == ["a", "b"]


def test_interpretation_rules(spark):
    answer = lambda **k: json.dumps({"proposed_feature": None, "topic_description": "d", "supporting_review_ids": ["e1"], "assessment": "mixed", **k})
    rows = [("1", answer()), ("2", answer(supporting_review_ids=["e9"])), ("3", answer(proposed_feature="login")), ("4", answer(supporting_review_ids=[])), ("5", "no json"), ("6", answer(assessment="single_feature", proposed_feature="login"))]
    df = spark.createDataFrame([(0, a, r, ["e1", "e2"]) for a, r in rows], "topic_id int, attempt_id string, response string, evidence array<string>")
    got = {}
    for r in Ev.response_problems(df).collect():
        got.setdefault(r["attempt_id"], set()).add(r["rule"])
    assert got["2"] == {"foreign_citation"} and got["3"] == {"feature_must_be_null"} and got["4"] == {"no_citation"} and "not_an_object" in got["5"]
    assert "1" not in got and "6" not in got


def test_classification_never_turns_failure_into_neutral(spark):
    def prepare(text):
        if "bad" in text:
            raise ValueError
        return text.replace("@", "")

    rows = spark.createDataFrame([("a", "good"), ("b", " "), ("c", "bad"), ("d", "@"), ("e", None)], "record_id string, embedding_text string")
    got = {r["record_id"]: r for r in Se.classify(rows, lambda t: np.array([[0.4, 0.4, 0.2]] * len(t)), prepare=prepare).collect()}
    assert {k: (r["status"], r["label"], r["reason"]) for k, r in got.items()} == {
        "a": ("classified", "negative", None), "b": ("excluded", None, "empty_text"), "c": ("failed", None, "preprocessing_error"),
        "d": ("excluded", None, "empty_preprocessed_text"), "e": ("excluded", None, "empty_text")}
    assert got["a"]["input_hash"] == hashlib.sha256(b"good").hexdigest() and got["c"]["p_neutral"] is None


def test_net_sentiment(spark):
    rows = spark.createDataFrame([(0, "classified", "negative"), (0, "failed", None), (1, "excluded", None)], "topic_id int, status string, label string")
    got = {r["topic_id"]: r for r in Se.topic_sentiment(rows).collect()}
    assert got[0]["net_sentiment"] == -1.0 and got[0]["classified_fraction"] == 0.5
    assert got[1]["net_sentiment"] is None and got[1]["negative_share"] is None


def test_worst_topic_prefers_sure_shares(spark):
    rows = [(0, "negative")] * 14 + [(1, "negative")] * 91 + [(1, "positive")] * 5 + [(2, "negative")] * 4
    df = spark.createDataFrame(rows, "topic_id int, sentiment string").withColumns({"assessment": F.lit("mixed"), "title": F.lit("t")})
    assert M.worst_topic(df).first()["topic_id"] == 1
    low = spark.range(1).select(wilson_low(F.lit(91), F.lit(96)), wilson_low(F.lit(0), F.lit(0))).first()
    p, z, m = 91 / 96, 1.96, 96
    assert low[0] == pytest.approx((p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)) and low[1] == 0.0


def test_folds_and_splits(spark):
    rows = spark.createDataFrame([(str(i), "x" if i % 3 else "youtube", int(i % 4 > 0)) for i in range(400)], "record_id string, platform string, target int")
    for r in L.stratified_folds(rows).groupBy("platform", "target").pivot("fold", list(range(5))).count().collect():
        sizes = [r[str(f)] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    texts = spark.createDataFrame([(str(i), f"Text {i % 300}!" if i % 2 else f"text  {i % 300}", ["negative", "positive"][i % 300 % 2]) for i in range(900)], "record_id string, text string, label string")
    split = L.grouped_split(texts, 60, 20, 20).cache()
    assert split.count() == 900
    assert split.groupBy("text_group").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert L.largest_gap(L.split_distribution(split)).first()["largest_gap"] < 5
    with pytest.raises(ValueError):
        L.grouped_split(texts, 60, 20, 10)


def test_scores(spark):
    rows = spark.createDataFrame([(1, 1)] * 110 + [(1, 0)] * 6 + [(0, 1)] * 10 + [(0, 0)] * 42, "target int, prediction int")
    got = L.summary_scores(L.confusion(rows, "target", "prediction")).first()
    assert [round(got[k], 3) for k in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")] == [0.905, 0.878, 0.917, 0.948, 0.932]
    never = spark.createDataFrame([(1, 0), (0, 0)], "target int, prediction int")
    assert L.summary_scores(L.confusion(never, "target", "prediction")).first()["precision"] == 0.0


def test_gate_passes_stores(spark):
    rows = spark.createDataFrame([("google_play", None), ("x", 0), ("x", 1), ("youtube", None)], "platform string, prediction int")
    assert sorted((r["platform"], r["prediction"]) for r in L.relevance_gate(rows).collect() if r["platform"] == "x") == [("x", 1)]
    assert L.relevance_gate(rows).count() == 2


def test_text_hash_is_exact(spark):
    got = spark.createDataFrame([(" Hola ",), ("é",), ("é",)], "t string").select(text_hash(F.col("t"))).collect()
    assert [r[0] for r in got] == [hashlib.sha256(t.encode()).hexdigest() for t in (" Hola ", "é", "é")]


def test_mart_grows_by_commits_and_reads_only_its_months(spark, tmp_path):
    def reviews(*rows):
        return spark.createDataFrame([(f"r{i}", i, f"text {i}", platform, topic, "mixed", f"T{topic}", label, 0.9, 3, month)
                                      for i, platform, topic, label, month in rows], M.MART_SCHEMA)

    mart = M.StoredMart(str(tmp_path / "mart"))
    first = [(1, "x", 0, "negative", "2024-01"), (2, "x", 0, "neutral", "2024-01"), (3, "youtube", 1, "positive", "2024-02")]
    mart.commit(1, reviews(*first))
    # One review moves to another topic and label, another month is added; the commit is made twice.
    changed, before = (2, "x", 1, "positive", "2024-02"), first[1]
    for _ in range(2):
        mart.commit(2, reviews(changed, (4, "x", 1, "negative", "2024-03")), reviews(before))
    mart.commit(3, reviews(before), reviews(changed))  # and back again
    found = sorted((r["record_id"], r["topic_id"], r["month"]) for r in mart.reviews(spark).collect())
    assert found == [("r1", 0, "2024-01"), ("r2", 0, "2024-01"), ("r3", 1, "2024-02"), ("r4", 1, "2024-03")]
    assert {(r["month"], r["topic_id"], r["sentiment"]): r["reviews"] for r in mart.counts(spark).collect()} == {
        ("2024-01", 0, "negative"): 1, ("2024-01", 0, "neutral"): 1, ("2024-02", 1, "positive"): 1, ("2024-03", 1, "negative"): 1}
    view = M.Filter(platforms=["x"], first_month="2024-02")
    assert M.kpis(M.in_view(mart.counts(spark), view)).first() == M.kpis(mart.reviews(spark, view)).first()
    peak = M.trend(mart.counts(spark), mart.counts(spark).select("month").distinct()).orderBy("month").collect()
    assert [(r["total"], r["is_peak"]) for r in peak] == [(2, True), (1, False), (1, False)]
    plan = mart.reviews(spark, view)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
