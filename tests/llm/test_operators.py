"""Operators on small tables with nulls, repeats, ties, empty tables and clashing columns; queries against their SQL."""

import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from reviewmill.llm import (
    decontaminate, edit_counts, fixity, jaccard_join, multi_index, piece_lattice, secrets, templates, token_files, toxicity,
)
from reviewmill.llm.encoding import piece_encoder
from reviewmill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
TEXTS = [(1, "one two three four five six"), (1, "one two three four five six"), (3, None), (4, ""), (5, "short one"),
         (6, "Short  ONE"), (None, "one two three four five six"), (7, LONG), (8, LONG + "end"), (9, "password=abcdefgh x")]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, token string, size int, digest string, label int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "d", 0) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def test_token_files(docs, none):
    rows = sorted(token_files.token_index(docs).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    encoder, start = piece_encoder(), 0
    by_id = {i: t or "" for i, t in TEXTS}
    for row in rows:
        ids = encoder.whole(by_id[row["doc_id"]]) + np.array([2], "<u4").tobytes()
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert token_files.token_index(none).collect() == []


def test_edit_counts(docs, none):
    rows = edit_counts.edited_counts(docs).collect()
    assert len(rows) == len(TEXTS)
    found = {r["doc_id"]: r for r in rows}
    assert found[3]["n_tokens"] == found[4]["n_tokens"] == 0
    assert found[9]["n_edits"] == 1 and found[9]["n_tokens_edited"] == len(piece_encoder().whole("[removed] x")) // 4
    assert edit_counts.edited_counts(none).collect() == []


def test_pieces(docs, none):
    rows = piece_lattice.encode_pieces(docs, with_ids=True).collect()
    assert len(rows) == len(TEXTS) and all(r["round_trip"] for r in rows)
    assert {r["n_pieces"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    assert piece_lattice.encode_pieces(none).collect() == []


@pytest.mark.parametrize("n_best", [1, 2, 4])
def test_all_best_paths_of_a_text_are_given(spark, n_best):
    texts = ["one two one two", "", None, "the ancient \x00 theatre", "▁mark", "a", "x" * 2500 + " two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in piece_lattice.encode_pieces(docs, n_best=n_best, with_path_ids=True).collect()}
    lattice = piece_lattice.lattice(piece_lattice.PIECES, n_best)
    for doc_id, text in enumerate(texts):
        row, wanted = rows[doc_id], lattice.best_texts(text or "")
        assert [path["score"] for path in row["paths"]] == pytest.approx([score for score, _ in wanted])
        assert row["n_paths"] == len(row["paths"]) == len({tuple(path["ids"]) for path in row["paths"]})
        for path in row["paths"]:
            raw = np.array(path["ids"], "<u4").tobytes()
            assert lattice.decode(raw) == (text or "").replace("▁", " ")
            assert (path["n_pieces"], path["ids_crc32"], path["round_trip"]) == (len(raw) // 4, zlib.crc32(raw), "▁" not in (text or ""))
        assert row["second_score"] == (pytest.approx(row["paths"][1]["score"]) if len(row["paths"]) > 1 else None)


def test_jaccard_edges(docs, none):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert rows == {(1, 2, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 5), (None, 2, None), (7, 1, 7), (8, 2, 8), (9, 1, 9)}
    assert jaccard_join.jaccard_components(docs).count() == len(TEXTS)
    assert jaccard_join.jaccard_components(none).collect() == []


@pytest.mark.parametrize("crowd", [32, 3])
def test_jaccard_equals_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    random = np.random.default_rng(3)
    shared = [f"p{i}" for i in range(40)]
    rows, sets = [], {}
    for group in range(25):
        base = [f"g{group}w{i}" for i in range(int(random.integers(8, 60)))]
        for _ in range(int(random.integers(1, 7))):
            words = list(base)
            for _ in range(int(random.integers(0, 4))):
                words[int(random.integers(0, len(words)))] = f"x{random.integers(0, 9)}"
            if random.random() < 0.5:
                words += shared[:int(random.integers(20, 40))]
            sets[len(rows)] = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
            rows.append((len(rows), " ".join(words)))
    component = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    component[a] = component[b] = min(component[a], component[b])
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs_of(spark, rows)).collect()}
    assert found == component


def test_vectors(spark):
    random = np.random.default_rng(0)
    base = random.normal(size=(40, 8))
    rows = []
    for copy in range(5):
        for at, vector in enumerate(base):
            rows.append((len(rows), [float(x) for x in vector + 0.05 * copy * random.normal(size=8)], at % 3))
    rows += [(1000, rows[0][1], 0), (1001, None, 0), (1002, [0.0] * 8, 0), (1003, [float("nan")] * 8, 0),
             (1004, [None] + [1.0] * 7, 0), (1005, rows[0][1], None), (None, rows[0][1], 0), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0)]
    table = spark.createDataFrame([(*row, "x", 1) for row in rows], "vec_id bigint, embedding array<double>, label int, key string, rep int")
    found = {r["vec_id"]: r for r in multi_index.linked(table, reach=1.0).collect()}
    assert len(found) == len(rows)
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links = {r[0]: 0 for r in rows}
    component = {r[0]: r[0] for r in rows}
    pairs = [(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1])
             and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in range(20):
        for a, b in pairs:
            component[a] = component[b] = min(component[a], component[b])
    assert pairs and {i: r["n_links"] for i, r in found.items()} == links
    assert {i: r["component_id"] for i, r in found.items()} == component
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for i, r in found.items() if i is not None)
    assert multi_index.linked(table.limit(0)).collect() == []


@pytest.mark.parametrize("size, spectrum", [(4, 0), (64, 2)])
def test_multi_index_recall(spark, size, spectrum):
    """Links of every 50th vector against brute force, with as many codes as a large table has, where they are lost most easily."""
    random = np.random.default_rng(size)
    scale = 1.0 / np.arange(1, size + 1) ** spectrum
    base = random.normal(size=(900, size)) * scale
    near = base[random.integers(0, 900, 900)]
    drift = random.normal(size=near.shape) * scale
    drift -= (drift * near).sum(axis=1, keepdims=True) / (near ** 2).sum(axis=1, keepdims=True) * near
    wanted = random.uniform(0.98, 1.0, (900, 1))
    near = near + drift / np.linalg.norm(drift, axis=1, keepdims=True) * np.linalg.norm(near, axis=1, keepdims=True) * np.sqrt(1 - wanted ** 2) / wanted
    vectors = np.concatenate([base, near])
    table = spark.createDataFrame([(i, vector.tolist(), 0) for i, vector in enumerate(vectors)], "vec_id bigint, embedding array<double>, label int")
    found = {r["vec_id"]: r["n_links"] for r in multi_index.linked(table, cell_rows=1).collect()}
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    exact = (units @ units.T >= 0.98).sum(axis=1) - 1
    asked = [i for i in range(len(vectors)) if i % 50 == 0]
    assert all(found[i] <= exact[i] for i in range(len(vectors)))
    assert sum(found[i] for i in asked) >= 0.99 * sum(exact[i] for i in asked)
    assert sum(found.values()) >= 0.99 * exact.sum()


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "<p>" + "x" * (i % 50), 1) for i in range(700)]
                                  + [(None, None, None, 1), (7, "http://h/7", "<p>xxxxxxx", 1)], "page_id bigint, url string, html string, slot int")
    rows = fixity.replica_audit(pages).collect()
    status = {}
    for row in rows:
        status.setdefault(row["page_id"], []).append(row["status"])
    assert len(rows) == 704 and status[3] == ["missing"] and status[5] == ["changed"]
    assert status[-10] == status[-411] == ["extra"]
    assert sorted(status[7]) == ["changed", "changed"] and status[6] == ["moved"] and status[None] == ["same"]
    assert fixity.replica_audit(pages.limit(0)).collect() == []
    first = fixity.filed(fixity.records(pages))
    assert {r["status"] for r in fixity.audit(first, first).collect()} == {"same"}


def test_fixity_extra_records(spark):
    schema = "file_no bigint, slot int, page_id bigint, content string, bytes bigint"
    rows = [(f, i, None if i == 0 else 100 * f + i, f"c{f}-{i}", 10) for f in range(2) for i in range(20)]
    first = spark.createDataFrame(rows, schema)

    def found(extra, replica=rows):
        result = fixity.audit(first, spark.createDataFrame([*replica, *extra], schema)).collect()
        assert sum(r["status"] != "extra" for r in result) == len(rows)
        return sorted(((r["file_no"], r["page_id"], r["record_offset"], r["n_bytes"], r["status"]) for r in result
                       if r["status"] != "same"), key=str)

    assert found([]) == []
    # At a file's end: a new record, a repeated one and one without an id; and a whole file.
    assert found([(0, 20, 90, "new", 7)]) == [(0, 90, 200, 7, "extra")]
    assert found([(1, 20, 119, "c1-19", 10)]) == [(1, 119, 200, 10, "extra")]
    assert found([(1, 20, None, "c1-0", 10)]) == [(1, None, 200, 10, "extra")]
    assert found([(5, 0, 700, "x", 3), (5, 1, None, "y", 4)]) == [(5, 700, 0, 3, "extra"), (5, None, 3, 4, "extra")]
    middle = [(f, i + (f == 0 and i > 9), p, c, b) for f, i, p, c, b in rows]
    assert found([(0, 10, 90, "new", 7)], middle) == sorted(
        [(0, 90, 100, 7, "extra"), *((0, i, 10 * i, 10, "moved") for i in range(10, 20))], key=str)


def test_toxicity(spark, docs, none):
    rows = [(i, f"filler{i % 7} " + ("idiot" if i % 3 == 0 else "flower") + f" tail{i % 5}") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)] + [(1, 1, None), (None, 1, 1)],
                                   "doc_id bigint, quality int, toxic int")
    found = toxicity.toxicity(docs_of(spark, rows + [(700, None), (None, "idiot")]), labels).collect()
    assert len(found) == 602
    for row in found:
        if row["doc_id"] is not None and row["doc_id"] < 600:
            assert row["predicted"] == int(row["doc_id"] % 3 == 0)
            assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
    assert toxicity.toxicity(none, labels).collect() == []
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, "One two three four FIVE six", 1), (2, None, 1), (None, "x", 1), (3, "unseen passage of words", 1)],
                                  "item_id bigint, text string, doc_id int")
    rows = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["edits"]) for r in rows) == [(0, 1, 0), (1, 1, 0), (1, 1, 0)]
    assert decontaminate.contaminated(none, bench).collect() == []
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == []


def test_templates(spark):
    page = "<html><body><div id='a'>Fixed words on every page</div><div id='b'><p>text {0}</p></div></body></html>"
    rows = [(i, f"http://h.org/{i}", page.format(i), 1) for i in range(6)]
    rows += [(10, None, None, 1), (11, "http://single.org/", "<article><p>lone</p></article>", 1), (None, "http://h.org/x", "", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int")
    found = {r["page_id"]: r for r in templates.main_texts(pages).collect()}
    assert len(found) == len(rows)
    assert {found[i]["text"] for i in range(6)} == {f"text {i}" for i in range(6)}
    assert found[10]["text"] == "" and found[11]["text"] == "lone" and found[11]["n_chars"] == 4
    assert templates.main_texts(pages.limit(0)).collect() == []


def test_pages_without_host_are_a_site_of_their_own(spark):
    page = "<html><body><div id='a'>Fixed words on every page</div><div id='b'><p>text {0}</p></div></body></html>"
    rows = [(i, None, page.format(i)) for i in range(6)]
    rows += [(10 + i, f"http://small{i}.org/", f"<html><body><div><p>alone {i}</p></div></body></html>") for i in range(6)]
    found = {r["page_id"]: r["text"] for r in templates.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found == {**{i: f"text {i}" for i in range(6)}, **{10 + i: f"alone {i}" for i in range(6)}}


def test_templates_inside_articles(spark):
    page = ("<html><body><article><h1>Title {0}</h1><p>story {0} of the day, told at length for its readers {1}</p>{2}"
            "<div class='box'><p>Written by the desk</p><p>Follow us there</p></div></article></body></html>")
    common = "<p>A line that many stories quote</p>"
    rows = [(i, f"http://h.org/{i}", page.format(i, i * i, common if i % 5 < 3 else "")) for i in range(40)]
    # Few pages, copies of one page, and near copies are no ground to leave text out.
    rows += [(100 + i, f"http://few.org/{i}", page.format(i, i * i, common)) for i in range(6)]
    rows += [(200 + i, f"http://same.org/{i}", page.format(0, 0, common)) for i in range(40)]
    rows += [(300 + i, f"http://near.org/{i}", f"<article><p>{'long text of one release ' * 9}</p><p>day {i}</p></article>") for i in range(40)]
    found = {r["page_id"]: r["text"] for r in templates.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    quoted, box = "\n\nA line that many stories quote", "\n\nWritten by the desk\n\nFollow us there"
    story = lambda i: f"Title {i}\n\nstory {i} of the day, told at length for its readers {i * i}"
    assert all(found[i] == story(i) + (quoted if i % 5 < 3 else "") for i in range(40))
    assert all(found[100 + i] == story(i) + quoted + box for i in range(6))
    assert all(found[200 + i] == story(0) + quoted + box for i in range(40))
    assert all(found[300 + i] == ("long text of one release " * 9).strip() + f"\n\nday {i}" for i in range(40))


def test_pipeline_stages(spark, tmp_path):
    random = np.random.default_rng(2)
    body = lambda seed: " ".join(f"w{seed}x{random.integers(0, 10**6)}" for _ in range(40))
    clean = [(i, body(i)) for i in range(40)]
    copy = (40, clean[3][1] + " more")
    passage = "this passage of the benchmark must not be in the training data at all"
    toxic = [(100 + i, f"idiot {body(i)}") for i in range(40)]
    rows = [*clean, copy, (41, f"{body(41)} {passage} {body(42)}"), (42, f"{body(43)} password=abcdefgh9"), (43, None), (None, "lost id"), *toxic]
    docs = docs_of(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in rows if i is not None], "doc_id bigint, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {*range(40), 42, 43, None}
    assert all("abcdefgh9" not in (r["text"] or "") for r in kept.collect())
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in result} == ids and all(r["round_trip"] for r in result)


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    spark.createDataFrame([(1, "nothing that stands in them at all")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of(spark, [(i, f"text {i} with words that no other one has {i * i}") for i in range(4)]) \
        .withColumnsRenamed({"token": "_row", "size": "_ROW_"})
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontamination):
        assert sorted(map(tuple, stage(spark, docs, str(tmp_path)).collect())) == sorted(map(tuple, docs.collect()))


def test_pipeline_filters_rows_not_ids(spark, tmp_path):
    random = np.random.default_rng(4)
    body = lambda: " ".join(f"w{random.integers(0, 10**6)}" for _ in range(40))
    passage = "this passage of the benchmark must not be in the training data at all"
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak, clean = f"{body()} {passage} {body()}", body()
    docs = docs_of(spark, [(None, leak), (None, clean), (None, None), (5, leak), (5, clean), (6, passage)])
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(0, clean), (0, ""), (5, clean)])
    one, two, three, four = body(), body(), body(), body()
    docs = docs_of(spark, [(None, one), (None, one + " more"), (None, two), (7, three), (7, three), (7, four), (9, two), (8, two),
                           (None, ""), (None, ""), (3, None), (3, None)])
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    rows = sorted((r["doc_id"] or 0, (r["text"] or "").removesuffix(" more")) for r in kept.collect())
    assert rows == sorted([(0, one), (8, two), (7, three), (7, four), (0, ""), (0, ""), (3, ""), (3, "")])
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), str(tmp_path)).collect() == []


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, expected = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).fetchdf()
    order = sorted(got.columns)
    assert order == sorted(expected.columns)
    rows = [sorted(map(tuple, frame[order].astype(str).to_numpy().tolist())) for frame in (got, expected)]
    assert rows[0] == rows[1]
