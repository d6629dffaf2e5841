"""Line rules, periodic runs and centroid clustering against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewmill.llm import line_rules, runs, simplex_clusters
from reviewmill.llm.queries import QUERIES
from reviewmill.llm.word_ids import numbers_of, slices, split_words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, period int, words string, cluster int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), 1, "x", 2) for i, t in rows], SCHEMA)


# -- words -----------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é \x85\x1c\x0b\x0c\t\r\n", max_size=30)), max_size=6))
def test_words_of_texts(texts):
    words, starts = split_words(pa.array(texts, pa.string()))
    got = [words.to_pylist()[low:high] for low, high in zip(starts[:-1], starts[1:])]
    assert got == [WORD.findall(text or "") for text in texts]
    ids = numbers_of(words)
    assert all((ids[a] == ids[b]) == (words[a] == words[b]) for a in range(len(ids)) for b in range(len(ids)))


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 50, None, "", "y" * 500, "z", "z" * 99, "z"]})
    parts = list(slices(batch, most=100))
    assert [t for part in parts for t in part.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert max(part.num_rows for part in parts) > 1 and len(parts) > 2
    assert list(slices(batch.slice(0, 0))) == []


# -- line rules ------------------------------------------------------------

def repeated(words, size=8):
    windows = [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]
    times = Counter(windows)
    return len({p for i, window in enumerate(windows) if times[window] > 1 for p in range(i, i + size)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b"]), max_size=60), max_size=5))
def test_repeated_words(texts):
    words, starts = split_words(pa.array([" ".join(text) for text in texts], pa.string()))
    assert line_rules.repeated_words(numbers_of(words), starts).tolist() == [repeated(text) for text in texts]


@pytest.mark.parametrize("line, fault", [
    ("He came in and sat down.", None), ("He said: “come in!”", None), ("Wait?) Yes.", None), ("一切都好。", None),
    ("A first sentence. And one that was cut", None), ("Visit 192.168.0.1", "punctuation"), ("Latest posts", "punctuation"),
    ("WIN!! BIG!! NOW!! OR LOSE.", "punctuation"), ("word*** more$$$ signs&&& here.", "punctuation"),
    ("Home | News | About us.", "navigation"), ("Shop » Shoes » Boots.", "navigation"), ("The set {x | x > 0} is open.", None),
    ("All rights reserved.", "boilerplate"), ("Licensed under CC BY-NC 4.0. Enjoy.", "boilerplate"),
    ("He was licensed under the old law to carry on the trade of his father in the town where he was born, and "
     "nobody ever thought of asking him for papers.", None),
])
def test_line_faults(line, fault):
    assert line_rules.line_fault(line, len(WORD.findall(line))) == fault


PROSE = "The river ran along the old wall and under the bridge. Nobody had seen it so high since the year of the flood."


def test_line_verdicts(spark):
    long = "\n".join(f"Line {i} ends with {i * i}, as {i + 7} does too." for i in range(60_000))
    texts = [(1, PROSE), (2, PROSE + "\nHome | News | About\nAll rights reserved."), (3, "".join(f"a{i} | b{i} | c{i} | d{i}\n" for i in range(9)) + PROSE),
             (4, None), (5, ""), (6, " \n\t\n"), (7, "Too short."), (None, PROSE), (1, PROSE), (8, long),
             (9, (PROSE + "\n") * 2), (10, PROSE + "\r\n" + PROSE.upper() + "\n\n\n#*$%&|<>.")]
    docs = docs_of(spark, texts)
    rows = line_rules.line_verdicts(docs).collect()
    assert len(rows) == len(texts)
    found = {row["doc_id"]: row for row in rows}
    assert [found[i]["kept"] for i in (1, 2, 3, 4, 5, 6, 7, None, 8, 9, 10)] == [
        True, True, False, False, False, False, False, True, True, False, True]
    assert found[2]["n_lines_removed"] == 2 and found[3]["n_lines_removed"] == 9 and not found[3]["base_failed"]
    assert (found[8]["n_words"], found[8]["n_dup_lines"], found[8]["n_repeat_words"]) == (540_000, 0, 0)
    assert found[9]["n_dup_lines"] == 1 and found[9]["n_repeat_words"] == found[9]["n_words"]
    assert found[10]["n_symbols"] == 8 and found[10]["word_chars"] == len("".join(WORD.findall(texts[-1][1])))
    kept = line_rules.clean_texts(docs)
    assert kept.schema == docs.schema
    cleaned = {row["doc_id"]: row["text"] for row in kept.collect()}
    assert cleaned[2] == PROSE and cleaned[8] == long and set(cleaned) == {1, 2, None, 8, 10}
    assert line_rules.line_verdicts(docs_of(spark, [])).collect() == line_rules.clean_texts(docs_of(spark, [])).collect() == []


# -- runs ------------------------------------------------------------------

def all_runs(words, least_length=6, least_exponent=4):
    """Start, length and period, from the definition."""
    n, found = len(words), {}
    for q in range(1, n // least_exponent + 1):
        at = 0
        while at < n - q:
            end = at
            while end < n - q and words[end] == words[end + q]:
                end += 1
            if end + q - at >= max(least_length, least_exponent * q):
                found.setdefault((at, end + q - at), q)
            at = end + 1
    return sorted((start, length, q) for (start, length), q in found.items())


@st.composite
def word_lists(draw):
    letters = st.sampled_from("abc"[:draw(st.integers(1, 3))])
    parts = draw(st.lists(st.tuples(st.lists(letters, max_size=6), st.integers(1, 9)), max_size=4))
    return [word for part, times in parts for word in part * times]


@settings(max_examples=400, deadline=None)
@given(st.lists(word_lists(), max_size=4), st.sampled_from([(6, 4), (2, 2), (3, 3)]))
def test_runs_equal_the_definition(texts, least):
    numbers = {"a": 0, "b": 1, "c": 2}
    ids = np.array([numbers[word] for text in texts for word in text], np.int64)
    starts = np.concatenate(([0], np.cumsum([len(text) for text in texts]))).astype(np.int64)
    begin, end, period = runs.find_runs(ids, starts, *least)
    want = [(start + low, length, q) for low, text in zip(starts.tolist(), texts) for start, length, q in all_runs(text, *least)]
    assert list(zip(begin.tolist(), (end - begin).tolist(), period.tolist())) == sorted(want)


def test_fibonacci_words_and_chunks(monkeypatch):
    first, second = "a", "ab"
    while len(second) < 400:
        first, second = second, second + first
    ids = np.array([ord(letter) for letter in second], np.int64)
    for lookups in (1 << 22, 50):
        monkeypatch.setattr(runs, "LOOKUPS", lookups)
        begin, end, period = runs.find_runs(ids, np.array([0, len(ids)]), 2, 2)
        assert list(zip(begin.tolist(), (end - begin).tolist(), period.tolist())) == all_runs(second, 2, 2)


def expected_digest(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    hashed = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if hashed % 10 == 0 and n:
        g = hashed // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words)
    dropped = {i for start, length, q in found for i in range(start + q, start + length)}
    best = min(found, key=lambda run: (-run[1], run[0], run[2])) if found else (None, None, None)
    sha = lambda value: hashlib.sha256(value.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
            sha(" ".join(word for i, word in enumerate(words) if i not in dropped)))


def test_run_digests(spark):
    texts = [(i, "x y z " * i) for i in range(40)] + [
        (100, None), (101, ""), (102, " \t\n"), (None, "a " * 50), (103, "ha " * 7 + "he said so so so so so so"), (103, "ha " * 7),
        (104, "a b a b a b a b a b c a b a b a b a b"), (105, "go go " * 5)]
    got = sorted(map(tuple, runs.run_digests(docs_of(spark, texts)).collect()), key=str)
    assert got == sorted((expected_digest(*row) for row in texts), key=str)
    assert runs.run_digests(docs_of(spark, [])).collect() == []


def test_long_texts_and_plain_outputs(spark):
    words = [f"w{i * i % 7919}" for i in range(400_000)] + ["tick", "tock"] * 100_000 + ["end"]
    docs = docs_of(spark, [(1, " ".join(words)), (2, "one two"), (3, "na " * 12 + "batman"), (4, None)])
    found = {(r["doc_id"], r["start"], r["length"], r["period"]) for r in runs.periodic_runs(docs).collect()}
    assert (1, 400_000, 200_000, 2) in found and (3, 0, 12, 1) in found
    # A sequence of squares modulo a prime repeats with the prime itself.
    assert (1, 0, 400_000, 7919) in found and len(found) == 3
    texts = {r["doc_id"]: r["text"] for r in runs.without_repeats(docs).collect()}
    assert texts == {1: " ".join(words[:7919] + ["tick", "tock", "end"]), 2: "one two", 3: "na batman", 4: ""}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_runs_query_equals_the_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {row["doc_id"]: tuple(row) for row in QUERIES["op13_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        assert got[doc_id] == expected_digest(doc_id, text)


# -- clusters --------------------------------------------------------------

def plain_clusters(rows, k=16, rounds=3, size=64):
    """The contract with Python's own integers."""
    good = [(i, [int(np.floor(64.0 * np.float64(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda row: (row[0] is None, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])
    centroids = [list(v) for _, v in sorted(good, key=order)[:k]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in good]
        return [min(range(len(centroids)), key=lambda c: (row[c], c)) for row in far], far

    for _ in range(rounds):
        number, _ = assign()
        for c in range(len(centroids)):
            members = [v for (_, v), own in zip(good, number) if own == c]
            if members:
                centroids[c] = [sum(column) // len(members) for column in zip(*members)]
    number, far = assign()
    distance = [row[own] for row, own in zip(far, number)]
    inertia = Counter()
    for own, d in zip(number, distance):
        inertia[own] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, own, d, inertia[own], sum(distance), sha[own]) for (i, _), own, d in zip(good, number, distance)), key=str)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, None, 1, "x") for i, v in rows],
                                 "vec_id bigint, embedding array<float>, label int, distance int, vector string")


def test_clusters_equal_plain_integers(spark):
    random = np.random.default_rng(3)
    middles = random.normal(0, 1, (5, 64))
    rows = [(int(i), [float(np.float32(x)) for x in middles[i % 5] + random.normal(0, 0.4, 64)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(80)]  # a third of all rows is one vector
    rows += [(7, rows[3][1]), (7, rows[4][1]), (None, rows[5][1]), (None, None), (901, []), (902, [1.0] * 63),
             (903, [float("nan")] + [0.0] * 63), (904, [float("inf")] + [0.0] * 63), (905, [None] + [0.0] * 63), (906, [0.0] * 64)]
    got = simplex_clusters.clusters(vectors_of(spark, rows).repartition(5))
    assert got.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(row)[:6] for row in got.collect()), key=str) == plain_clusters(rows)


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(20)],
    [(i, [i / 8] * 64) for i in range(30)], [(i, [-i / 100, *[0.0] * 63]) for i in range(9)]])
def test_small_and_degenerate_clusters(spark, rows):
    got = simplex_clusters.clusters(vectors_of(spark, rows)).drop("n_compared").collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(rows)


@pytest.mark.parametrize("seed", range(40))
def test_bounds_hold_and_lose_nothing(seed):
    random = np.random.default_rng(seed)
    size = int(random.choice([1, 2, 5, 64]))
    top = int(random.choice([2, 40, simplex_clusters.LIMIT]))
    points = random.integers(-top, top + 1, (200, size))
    if seed % 3 == 0:  # nearly flat: pivots that hardly stand clear of each other
        points[:, 1:] = points[:, :1] + random.integers(0, 2, (200, size - 1))
    simplex = simplex_clusters.Simplex(points[random.choice(200, 16)])
    centroids = points[random.choice(200, 16)] + random.integers(-1, 2, (16, size))
    apexes = simplex.apexes(simplex.distances(points))
    exact = np.stack([simplex_clusters.squared(points, centroid) for centroid in centroids], axis=1)
    lower, upper = simplex_clusters.bounds(apexes, simplex.apexes(simplex.distances(centroids)))
    assert (lower <= exact).all() and (exact <= upper).all()
    best, distance, compared = simplex_clusters.nearest(points, apexes, centroids, simplex)
    assert (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and (compared >= 1).all()


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        simplex_clusters.clusters(vectors_of(spark, [(1, [1e30] + [0.0] * 63)])).collect()
