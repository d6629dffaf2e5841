"""Reconciliation against a plain sequential loop, and the store's rules."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill import schemas as S
from reviewmill.operators import store as R
from reviewmill.sources import bucket_store, revisions
from reviewmill.sources.revisions import Folder, RevisionLog, StaleParent
from reviewmill.streaming import keyed_state as K
from reviewmill.streaming import reconcile as St

T0 = datetime(2026, 9, 10, 12)


def observation(at, source_id, provider="play", app="example.app", **changes):
    row = dict(batch_order=at, provider=provider, app_id=app, source_id=str(source_id), country="mx", text=f"Original {source_id}",
               title=None, rating=3, app_version="1.0", updated_at=T0, fetched_at=T0 + timedelta(days=1))
    return {**row, **changes}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in S.OBSERVATIONS.fieldNames()) for r in rows], S.OBSERVATIONS)


def committed(spark, rows, identities=None, state=None, seq=1, width=1 << 16):
    identities = R.empty_identities(spark) if identities is None else identities
    state = R.empty_state(spark) if state is None else state
    classified = R.classify(frame(spark, rows), identities, state, width).cache()
    return classified, R.next_versions(classified, state, seq).cache()


def totals(classified):
    row = R.outcome_counts(classified).where("provider = '(all)'").first()
    return {o: row[o] for o in S.OUTCOMES}


def test_delta_counts_and_history(spark):
    _, seed = committed(spark, [observation(i, i) for i in range(100)])
    batch = [observation(i, i) for i in range(100, 110)] + [observation(200 + i, i, text="Edited") for i in (1, 2)] + [observation(300, 3)]
    classified, delta = committed(spark, batch, state=R.as_of(seed), seq=2)
    assert totals(classified) == {"inserted": 10, "edited": 2, "duplicates": 1, "stale": 0}
    versions = seed.unionByName(delta)
    assert versions.count() == 112
    assert R.as_of(versions).count() == 110 and R.as_of(versions, 1).count() == 100
    text = lambda rows: rows.where("record_id = 'play:example.app:1'").first()["text"]
    assert text(R.as_of(versions, 1)) == "Original 1" and text(R.as_of(versions)) == "Edited"
    diff = R.revision_diff(versions, 1, 2).groupBy("change").count().collect()
    assert {r["change"]: r["count"] for r in diff} == {"added": 10, "changed": 2}


def test_stale_row_cannot_replace_newer_content(spark):
    _, seed = committed(spark, [observation(0, 1)])
    old = observation(0, 1, text="old copy", updated_at=T0 - timedelta(days=9))
    classified, delta = committed(spark, [old], state=seed, seq=2)
    assert totals(classified)["stale"] == 1 and delta.count() == 0


def test_known_identity_keeps_its_record_and_defaults(spark):
    identities = spark.createDataFrame([("apple_rss", "123", "native", "appbot:historical")], S.IDENTITIES)
    _, seed = committed(spark, [observation(0, "native", "apple_rss", "123")], identities)
    seed = seed.withColumn("relevance", F.lit("human_relevant"))
    edit = observation(0, "native", "apple_rss", "123", text="Changed")
    classified, delta = committed(spark, [edit], identities, seed, 2)
    row = delta.first()
    assert (row["record_id"], row["relevance"], row["country"], row["platform"]) == ("appbot:historical", "human_relevant", "MX", "app_store")
    assert row["native"]["apple_rss__text"] == "Changed"
    assert R.new_identities(classified, identities).count() == 0


def sequential(batches):
    """What happens row by row, kept as simply as possible."""
    state, outcomes = {}, []
    for batch in batches:
        for row in batch:
            key = (row["provider"], row["app_id"], row["source_id"])
            content = tuple(row[f] for f in S.CONTENT_FIELDS)
            old = state.get(key)
            if old and old[1] is not None and row["updated_at"] < old[1]:
                outcomes.append("stale")
            elif old and old[0] == content and (old[1] is None or old[1] == row["updated_at"]):
                outcomes.append("duplicates")
            else:
                outcomes.append("edited" if old else "inserted")
                state[key] = (content, row["updated_at"])
    return state, outcomes


@pytest.mark.parametrize("seed,width", [(1, 7), (2, 64), (3, 1 << 16)])
def test_matches_sequential_loop(spark, seed, width):
    rng = random.Random(seed)

    def batch(start, rows):
        # One key holds about a third of all rows.
        return [observation(start + i, rng.choice([0, 0, 0, *range(1, 7)]), rng.choice(S.STORE_PROVIDERS), text=rng.choice("ab"), rating=rng.choice([1, 5, None]),
                            updated_at=T0 + timedelta(days=rng.randrange(4))) for i in range(rows)]

    first, second = batch(0, 150), batch(1000, 250)
    expected_state, outcomes = sequential([first, second])
    one, versions = committed(spark, first, width=width)
    two, delta = committed(spark, second, state=R.as_of(versions), seq=2, width=width)
    got = [r["outcome"] for part in (one, two) for r in part.orderBy("batch_order").collect()]
    assert got == outcomes
    final = R.as_of(versions.unionByName(delta)).collect()
    assert {tuple(r["record_id"].split(":")): ((r["text"], r["title"], r["rating"], "1.0"), r["updated_at"]) for r in final} == expected_state


@pytest.mark.parametrize("width", [1, 2, 1 << 16])
def test_undated_state_absorbs_equal_content(spark, width):
    _, seed = committed(spark, [observation(0, 1)])
    undated = seed.withColumn("native", F.map_filter("native", lambda k, _: ~k.endswith("updated_at")))
    rows = [observation(0, 1), observation(1, 1, updated_at=T0 - timedelta(days=5)), observation(2, 1, text="new"), observation(3, 1, updated_at=T0 - timedelta(days=5))]
    classified, _ = committed(spark, rows, state=undated, seq=2, width=width)
    assert [r["outcome"] for r in classified.orderBy("batch_order").collect()] == ["duplicates", "duplicates", "edited", "stale"]


def test_batch_gate_needs_both_stores(spark):
    gate = lambda rows: R.batch_gate(spark.createDataFrame(rows, "provider string, status string")).first()["may_commit"]
    assert gate([("play", "success"), ("apple_rss", "success")])
    assert not gate([("play", "success")]) and not gate([("play", "failed"), ("apple_rss", "success")])


def test_checkpoints_never_move_back(spark):
    schema = "scope string, value string, revision string"
    stored = spark.createDataFrame([("a", "2026-09-12", "r1"), ("b", "2026-09-12", "r1"), ("c", "2026-09-12", "r1")], schema)
    new = spark.createDataFrame([("a", "2026-09-10", "r2"), ("b", "2026-09-12", "r2"), ("d", "2026-09-01", "r2")], schema)
    got = {r["scope"]: (r["value"], r["revision"]) for r in R.upsert_checkpoints(stored, new).collect()}
    assert got == {"a": ("2026-09-12", "r1"), "b": ("2026-09-12", "r2"), "c": ("2026-09-12", "r1"), "d": ("2026-09-01", "r2")}


@pytest.mark.parametrize("locale", ['{"country": "mx", "lang": "es"}', "mx", None])
def test_boundary_reads_native_storefront(spark, locale):
    rows = spark.createDataFrame(
        [("play", "example.app", locale, "MX", T0), ("play", "example.app", '{"country": "us"}', "MX", T0 + timedelta(days=1))],
        "provider string, target string, locale string, country string, updated_at timestamp_ntz")
    sources = spark.createDataFrame([("play", "example.app", "mx"), ("apple_rss", "123", "mx")], "provider string, app_id string, country string")
    none = spark.createDataFrame([], "scope string, value timestamp_ntz")
    got = {r["provider"]: r["since"] for r in R.incremental_boundary(rows, sources, none, 7).collect()}
    assert got == {"play": datetime(2026, 9, 3, 12), "apple_rss": None}


def test_seed_problems(spark):
    seed = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "record_id string")
    assert {r["record_id"] for r in R.seed_problems(seed).collect()} == {"a", None}


def test_retried_micro_batch_changes_nothing(spark, tmp_path):
    store = St.Store(str(tmp_path / "store"))
    store.initialize(spark)
    batch = frame(spark, [observation(0, 1), observation(1, 2), observation(2, 1, text="b", updated_at=T0 + timedelta(days=1))])
    St.commit_batch(store, batch, 0)
    St.commit_batch(store, batch, 0)
    assert store.versions(spark).count() == 2 and store.revisions(spark).count() == 2
    St.commit_batch(store, batch, 1)
    row = store.revisions(spark).where("operation = 'stream-batch-1'").first()
    assert (row["inserted"], row["duplicates"], row["stale"]) == (0, 2, 1)
    assert store.checkpoints(spark).first()["value"] == T0 + timedelta(days=1)


def test_used_batch_number_with_other_rows_is_refused(spark, tmp_path):
    store = St.Store(str(tmp_path / "store"))
    store.initialize(spark)
    St.commit_batch(store, frame(spark, [observation(0, 1)]), 0)
    with pytest.raises(ValueError, match="other rows"):
        St.commit_batch(store, frame(spark, [observation(0, 2)]), 0)
    St.commit_batch(store, frame(spark, [observation(0, 2)]), 0, "second")
    assert store.versions(spark).count() == 2 and store.revisions(spark).agg(F.max("seq")).first()[0] == 3
    with pytest.raises(KeyError):
        store.at(spark, "unknown")
    assert store.at(spark, "stream-batch-0").count() == 1


def test_stream_loses_no_late_and_no_reverted_review(spark, tmp_path):
    store = St.Store(str(tmp_path / "store"))
    store.initialize(spark)
    landing, late = str(tmp_path / "landing"), timedelta(days=10)
    for rows in (
        [observation(0, 1, text="A", fetched_at=T0)],
        [observation(0, 1, text="B", fetched_at=T0 + late), observation(1, 2, fetched_at=T0 + late)],
        [observation(0, 1, text="A", fetched_at=T0 + 2 * late), observation(1, 3, fetched_at=T0 - late, updated_at=T0 - late)],
    ):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(landing)
        St.reconcile_stream(St.landed(spark, landing), store, str(tmp_path / "progress")).awaitTermination()
    state = {r["record_id"][-1]: r["text"] for r in R.as_of(store.versions(spark)).collect()}
    assert state == {"1": "A", "2": "Original 2", "3": "Original 3"}
    assert [r["edited"] for r in store.revisions(spark).orderBy("seq").collect()] == [0, 0, 1, 1]


def test_seed_is_the_first_revision(spark, tmp_path):
    store = St.Store(str(tmp_path / "store"))
    seed = spark.createDataFrame(
        [("r1", "google_play", "example.app", "MX", "old", "2026-09-01T00:00:00+00:00", "77", "example.app")],
        "record_id string, platform string, app_id string, country string, text string, updated_at string, play__source_id string, play__target string")
    store.initialize(spark, seed=seed)
    with pytest.raises(ValueError, match="not empty"):
        store.initialize(spark, seed=seed)
    with pytest.raises(ValueError, match="repeated"):
        St.Store(str(tmp_path / "other")).initialize(spark, seed=seed.unionByName(seed))
    first = store.at(spark, "seed").first()
    assert (first["text"], first["updated_at"], first["native"]["play__source_id"]) == ("old", datetime(2026, 9, 1), "77")
    St.commit_batch(store, frame(spark, [observation(0, 77, text="new")]), 0)
    assert [r["text"] for r in R.as_of(store.versions(spark)).collect()] == ["new"]


def test_stored_dates_are_utc_in_any_session(spark):
    _, seed = committed(spark, [observation(0, 1, updated_at=datetime(2024, 1, 20, 3))])
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "America/Mexico_City"):
            spark.conf.set("spark.sql.session.timeZone", other)
            classified, _ = committed(spark, [observation(0, 1, text="x", updated_at=datetime(2024, 1, 20, 1))], state=R.as_of(seed), seq=2)
            assert totals(classified)["stale"] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_malformed_page_refuses_the_batch(spark, tmp_path):
    store = St.Store(str(tmp_path / "store"))
    store.initialize(spark)
    page = "body string, capture_ref string, app_id string, country string, fetched_at timestamp_ntz"
    feed = spark.createDataFrame([('{"feed":{"entry":{"id":{"label":"7"},"updated":{"label":"2026-09-01T00:00:00Z"},"content":{"label":"ok"},'
                                   '"title":{"label":"t"},"im:rating":{"label":"9"}}}}', "f1", "a", "mx", T0)], page)
    body = ")]}'\n\n[[\"wrb.fr\",\"x\",\"[[[\\\"r1\\\",[],5,null,\\\"good\\\",[1788220800]]],[null,null],null]\"]]"
    good, bad = spark.createDataFrame([(body, "r1", "a", "mx", T0)], page), spark.createDataFrame([("<html>blocked", "r2", "a", "mx", T0)], page)
    window = (T0 - timedelta(days=30), T0)
    with pytest.raises(ValueError, match="malformed"):
        St.commit_pages(store, feed, good.unionByName(bad), *window, 0)
    assert store.versions(spark).count() == 0
    quarantined = St.commit_pages(store, feed, good, *window, 0)
    assert [r["rule"] for r in quarantined.collect()] == ["invalid_rating"]
    assert [(r["record_id"], r["text"]) for r in store.at(spark, "pages-batch-0").collect()] == [("play:a:r1", "good")]
    assert store.checkpoints(spark).first()["value"] == T0


def test_every_number_goes_to_one_writer(spark, tmp_path):
    log = RevisionLog(Folder(str(tmp_path / "store")))
    with ThreadPoolExecutor(8) as pool:
        asked = [{"seq": seq, "id": f"{seq}-{writer}", "operation": f"{writer}"} for seq in range(1, 13) for writer in range(8)]
        won = [record for record, taken in zip(asked, pool.map(lambda record: log.append(spark, record), asked)) if taken]
    assert sorted(record["seq"] for record in won) == list(range(1, 13)) == log.numbers(spark)
    assert log.records(spark) == sorted(won, key=lambda record: record["seq"])
    assert log.folder.names(spark, "attempts") == []


def test_two_writers_lose_nothing(spark, tmp_path):
    store = St.Store(str(tmp_path / "store"))
    store.initialize(spark, buckets=2)
    writers = {"a": [observation(i, i) for i in range(6)], "b": [observation(i, i, text="b", updated_at=T0 + timedelta(days=1)) for i in range(3, 9)]}
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda name: St.commit_rows(store, frame(spark, writers[name]), name), writers))
    assert sorted(record["seq"] for record in done) == [2, 3]
    state = {row["record_id"].split(":")[-1]: row["text"] for row in store.state(spark).collect()}
    assert state == {str(i): "b" if i >= 3 else f"Original {i}" for i in range(9)}
    first, second = sorted(done, key=lambda record: record["seq"])
    assert second["parent"] == first["id"]
    # A commit against a revision that is no longer the newest is refused, a repeated one is not made again.
    with pytest.raises(StaleParent):
        St.commit_rows(store, frame(spark, [observation(0, 50)]), "late", parent=first["id"])
    assert St.commit_rows(store, frame(spark, writers["a"]), "a")["id"] == done[0]["id"]
    with pytest.raises(ValueError, match="another parent"):
        St.commit_rows(store, frame(spark, writers["a"]), "a", parent=second["id"])
    assert store.revisions(spark).count() == 3


def test_reads_do_not_grow_with_the_revisions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bucket_store, "COMPACTED", 2)
    monkeypatch.setattr(revisions, "SUMMED", 3)
    store = St.Store(str(tmp_path / "store"))
    store.initialize(spark, buckets=2)
    at = lambda k: T0 + timedelta(days=k)
    for k in range(1, 6):
        rows = [observation(0, "same", text=f"turn {k}", updated_at=at(k)), observation(1, k, updated_at=at(k))]
        St.commit_rows(store, frame(spark, rows), f"turn {k}")
        assert max(len(added) + bool(base) for table in store.view(spark).manifest.parts.values() for base, added in table.values()) <= 2
    assert store.folder.names(spark, "log-sums") == ["3"] or sorted(store.folder.names(spark, "log-sums")) == ["3", "6"]
    # Every revision can still be read as it was, and the history is whole.
    for k in range(1, 6):
        texts = sorted(row["text"] for row in store.at(spark, f"turn {k}").collect())
        assert texts == sorted([f"turn {k}", *(f"Original {j}" for j in range(1, k + 1))])
    assert store.versions(spark).count() == 10 and store.identities(spark).count() == 6
    assert [row["operation"] for row in store.revisions(spark).orderBy("seq").collect()] == ["seed", *(f"turn {k}" for k in range(1, 6))]
    # Only the buckets of the asked records are read.
    view = store.view(spark)
    one = spark.createDataFrame([("play:example.app:1",)], "record_id string")
    read = view.read(spark, "versions", view.buckets(one, "versions")).inputFiles()
    assert len({path.split("bucket=")[1].split("/")[0] for path in read}) == 1
    assert view.state_of(one).first()["text"] == "Original 1"
    # What a lost writer left behind is not seen, and can be removed.
    store.folder.write(spark, "data/lost/manifest.json", "{}")
    assert store.state(spark).count() == 6 and store.clean(spark) == ["lost"] and store.clean(spark) == []


def test_accepted_versions_keep_their_provenance(spark):
    rows = frame(spark, [observation(0, 1)]).withColumns({name: F.lit(f"{name} of it") for name in S.PROVENANCE})
    classified = R.classify(rows, R.empty_identities(spark), R.empty_state(spark))
    native = R.next_versions(classified, R.empty_state(spark), 1).first()["native"]
    assert {name: native[f"play__{name}"] for name in S.PROVENANCE} == {name: f"{name} of it" for name in S.PROVENANCE}
    assert (native["play__schema_version"], native["play__collected_via"]) == ("unified-update-v1", "newest")


@pytest.mark.parametrize("seed", range(60))
def test_keyed_outcomes_equal_the_loop(seed):
    random_ = random.Random(seed)
    known = random_.random() < 0.5
    stored = (random_.randrange(3), random_.choice([K.NO_DATE, 1, 2]))
    rows = [(random_.randrange(3), random_.choice([1, 2, 3])) for _ in range(random_.randrange(1, 9))]
    content, at = stored if known else (-1, K.NO_DATE)
    seen, undated, want, last = known, known and stored[1] == K.NO_DATE, [], -1
    for place, (code, date) in enumerate(rows):
        if undated and code == content:
            want.append(2)
        elif at != K.NO_DATE and date < at:
            want.append(3)
        elif seen and (code, date) == (content, at):
            want.append(2)
        else:
            want.append(1 if seen else 0)
            content, at, seen, undated, last = code, date, True, False, place
    first = stored if known else (-1, K.NO_DATE)
    found, place = K.outcomes(np.array([date for _, date in rows]), np.array([code for code, _ in rows]), known, *first)
    assert found.tolist() == want and place == last


def test_keyed_stream_starts_on_a_store_and_goes_on(spark, tmp_path):
    identities = spark.createDataFrame([("apple_rss", "123", "n", "old:1")], S.IDENTITIES)
    _, seed = committed(spark, [observation(0, 1), observation(1, 2), observation(2, "n", "apple_rss", "123")], identities)
    landing, late = str(tmp_path / "landing"), timedelta(days=3)
    for k, rows in enumerate((
        [observation(0, 1), observation(1, 2, text="new", updated_at=T0 + late), observation(2, "n", "apple_rss", "123", title="t")],
        [observation(0, 1, updated_at=T0 - late), observation(1, 2), observation(2, 3)],
        [observation(0, 3, text="x", updated_at=T0 + late), observation(1, 3, text="y", updated_at=T0 + late, fetched_at=T0 + 2 * late)],
    )):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(landing)
        changes = K.keyed_changes(St.landed(spark, landing), identities, R.as_of(seed))
        K.follow(changes, str(tmp_path / "changes"), str(tmp_path / "progress")).awaitTermination()
        found = {(r["batch"], r["record_id"].split(":")[-1]): tuple(r[o] for o in S.OUTCOMES)
                 for r in K.changes_at(spark, str(tmp_path / "changes")).collect()}
        assert {batch for batch, _ in found} == set(range(k + 1))
    assert found == {
        (0, "1"): (0, 0, 1, 0), (0, "2"): (0, 1, 0, 0), (1, "1"): (0, 0, 0, 1), (1, "2"): (0, 0, 0, 1), (1, "3"): (1, 0, 0, 0),
        (2, "3"): (0, 2, 0, 0)} | {(0, "1"): found[0, "1"]}
    newest = {r["record_id"]: (r["text"], r["title"]) for r in K.latest(K.changes_at(spark, str(tmp_path / "changes"))).collect()}
    assert newest == {"play:example.app:2": ("new", None), "play:example.app:3": ("y", None), "old:1": ("Original n", "t")}
