"""Periodic runs of words, found with an enhanced suffix array.

A run is a stretch of words with smallest period ``q`` that no neighbouring word
extends.  A run of exponent two or more ends with exactly one branching square
``w w`` of its period: ``w`` begins at ``i`` and at ``i + q``, and different words
(or the end) follow.  So ``i`` and ``i + q`` lie in the interval of suffixes that
begin with ``w``, whose common depth is ``q``, and in different children of it.
For every such interval the suffixes of all children but the largest look up
``ISA[i + q]`` and ``ISA[i - q]``: inside the interval and outside the own child
means a branching square.  Each is rotated to the left while the words a period
apart agree, which gives the whole run; of the runs over one stretch the smallest
period stays.  There are no tree nodes: intervals are bounds in the array of
common prefixes, and all steps are array operations over many texts at once.

Suffixes are ordered by prefix doubling.  Words of different texts never count
as equal, so nothing crosses a text.  The ranks of every doubling step are kept:
they compare any two stretches, for the common prefixes and for the rotations.
With the least exponent ``k`` the root ``w`` of a run occurs ``k`` times, so
intervals with fewer suffixes are passed over; no run is lost by that.

Memory: about 100 to 300 bytes per word of the texts worked at once, which are
about 2 MB or one longer text.

Edge cases: null and empty texts have no words and no runs; a null ``doc_id``
keeps its words as they are; repeated rows give rows of their own; an empty table
gives no rows; other columns are ignored; texts are used whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_ids import numbers_of, slices, split_words

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Suffixes of small children looked up at once.
LOOKUPS = 1 << 22

DIGEST = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, " \
    "runs_sha256 string, collapsed_sha256 string"


class SuffixArray:
    """Order of the suffixes of ``symbols``, their common prefixes, and ranks by the first 1, 2, 4, ... symbols."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        fresh = np.concatenate(([True], symbols[order][1:] != symbols[order][:-1]))
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, n))
        rank = np.full(n + 1, -1, np.int64)
        rank[order] = np.repeat(heads, sizes)
        self.levels = [rank.astype(np.int32)]
        split = np.full(n, -1, np.int8)
        undecided = order[np.repeat(sizes > 1, sizes)]
        width = 1
        while len(undecided):
            first, second = rank[undecided], rank[undecided + width]
            key = first * (n + 1) + second + 1
            by = np.argsort(key)
            # Groups of equal ``first`` lie together and keep their places, so ``first`` itself stays in order.
            undecided, key = undecided[by], key[by]
            group = np.concatenate(([True], first[1:] != first[:-1]))
            part = np.concatenate(([True], key[1:] != key[:-1]))
            at = np.arange(len(key))
            place = first + at - np.maximum.accumulate(np.where(group, at, 0))
            heads = np.flatnonzero(part)
            sizes = np.diff(np.append(heads, len(key)))
            rank[undecided] = np.repeat(place[heads], sizes)
            split[place[part & ~group]] = len(self.levels) - 1
            self.levels.append(rank.astype(np.int32))
            undecided = undecided[np.repeat(sizes > 1, sizes)]
            width *= 2
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank[:n]] = np.arange(n)
        # Neighbours that step k told apart share 2^k symbols and fewer than twice as many.
        self.common = np.zeros(n + 1, np.int64)
        self.common[[0, n]] = -1
        for level in range(len(self.levels) - 1):
            places = np.flatnonzero(split == level)
            left, right = self.order[places - 1], self.order[places]
            length = np.full(len(places), 1 << level)
            for step in range(level - 1, -1, -1):
                same = self.levels[step][left + length] == self.levels[step][right + length]
                length += same.astype(np.int64) << step
            self.common[places] = length

    def rotated(self, start: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How far left the words stay equal to those a period later: the start of the run of a square."""
        start = start.copy()
        for step in range(len(self.levels) - 1, -1, -1):
            ranks, back = self.levels[step], start - (1 << step)
            at = np.maximum(back, 0)
            start = np.where((back >= 0) & (ranks[at] == ranks[at + period]), back, start)
        return start


def intervals(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of ``common`` inside an interval of at least ``least`` suffixes, and the interval's bounds (end exclusive)."""
    n = len(common) - 1
    tables = [common.astype(np.int32)]
    while (2 << (len(tables) - 1)) <= n:
        half, last = 1 << (len(tables) - 1), tables[-1]
        tables.append(np.minimum(last, np.concatenate((last[half:], np.full(half, -1, np.int32)))))
    places = np.flatnonzero(common > 0)
    depth = common[places]
    # ``least`` suffixes: so many places less one in a row reach the depth.
    enough = np.zeros(len(places), bool)
    for before in range(least - 1):
        near = np.ones(len(places), bool)
        for step in range(-before, least - 1 - before):
            near &= common[np.clip(places + step, 0, n)] >= depth
        enough |= near
    places, depth = places[enough], depth[enough]
    high, low = places + 1, places - 1
    for step in range(len(tables) - 1, -1, -1):
        table = tables[step]
        high = np.where(table[np.minimum(high, n)] >= depth, high + (1 << step), high)
        back = low - (1 << step) + 1
        low = np.where((back >= 0) & (table[np.maximum(back, 0)] >= depth), low - (1 << step), low)
    return places, low, high


def squares(suffixes: SuffixArray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of the branching squares whose root occurs at least ``least`` times."""
    places, low, high = intervals(suffixes.common, least)
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, rank, order = suffixes.n, suffixes.rank, suffixes.order
    by = np.lexsort((places, high, low))
    places, low, high = places[by], low[by], high[by]
    fresh = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
    last = np.append(fresh[1:], True)
    owner = np.cumsum(fresh) - 1
    # A child ends at every place of an interval, and one more after its last place.
    left = np.where(fresh, low, np.concatenate(([0], places[:-1])))
    begins = np.concatenate((left, places[last]))
    ends = np.concatenate((places, high[last]))
    of = np.concatenate((owner, owner[last]))
    largest = np.zeros(int(owner[-1]) + 1, np.int64)
    np.maximum.at(largest, of, ends - begins)
    widest = np.flatnonzero(ends - begins == largest[of])
    spared = widest[np.unique(of[widest], return_index=True)[1]]
    small = np.ones(len(of), bool)
    small[spared] = False
    begins, ends, of = begins[small], ends[small], of[small]
    depth, lows, highs = suffixes.common[places[fresh]][of], low[fresh][of], high[fresh][of]
    sizes = ends - begins
    upto = np.cumsum(sizes)
    found, at = [], 0
    while at < len(sizes):
        spent = upto[at - 1] if at else 0
        to = max(int(np.searchsorted(upto, spent + LOOKUPS, "right")), at + 1)
        child = np.repeat(np.arange(at, to), sizes[at:to])
        within = np.arange(len(child)) - (upto[child] - sizes[child] - spent)
        suffix, q = order[begins[child] + within], depth[child]
        for other, start in ((suffix + q, suffix), (suffix - q, suffix - q)):
            real = (other >= 0) & (other <= n)
            spot = rank[np.where(real, other, n)]
            inside = (spot >= lows[child]) & (spot < highs[child]) & ~((spot >= begins[child]) & (spot < ends[child]))
            found.append(np.stack((start[inside], q[inside])))
        at = to
    start, period = np.unique(np.concatenate(found, axis=1), axis=1)
    return start, period


def find_runs(ids: np.ndarray, starts: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT,
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs in texts of numbered words, in order; ``starts`` has one entry more than texts.

    A run has at least ``least_length`` words and ``least_exponent`` (two or more) periods.
    """
    none = np.zeros(0, np.int64)
    if not len(ids):
        return none, none, none
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    suffixes = SuffixArray(owner * (int(ids.max()) + 1) + ids)
    begin, period = squares(suffixes, least_exponent)
    start, end = suffixes.rotated(begin, period), begin + 2 * period
    real = end - start >= np.maximum(least_length, least_exponent * period)
    start, end, period = start[real], end[real], period[real]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    # One stretch has one smallest period; the others are its multiples.
    fresh = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1]))) if len(start) else np.zeros(0, bool)
    start, end, period = start[fresh], end[fresh], period[fresh]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def repeats_in(size: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``size`` words lie in a run after its first period."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, end, -1)
    return np.cumsum(edges[:-1]) > 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Where every word of a text comes from if its id asks for a planted run: a part of it over and over from some word on."""
    if doc_id is None or not n:
        return None
    hashed = zlib.crc32(str(doc_id).encode())
    if hashed % 10:
        return None
    seed = hashed // 10
    first = seed % n
    period = 1 + (n - first) // (3 + seed % 8)
    at = np.arange(n)
    return np.where(at < first, at, first + (at - first) % period)


def word_table(rows: pa.RecordBatch, plant: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of a slice, their numbers and where every text starts, with planted runs if asked for."""
    words, starts = split_words(rows.column("text"))
    if plant:
        origin = np.arange(len(words))
        for row, doc_id in enumerate(rows.column("doc_id").to_pylist()):
            moved = planted(doc_id, int(starts[row + 1] - starts[row]))
            if moved is not None:
                origin[starts[row]:starts[row + 1]] = starts[row] + moved
        words = words.take(pa.array(origin))
    return words, numbers_of(words), starts


def joined(words: pa.Array, starts: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Every text's kept words with one space between them."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(keep)))[starts], pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, words.filter(pa.array(keep))), pa.scalar(" ", pa.large_string()))


def digest(rows: pa.RecordBatch, plant: bool) -> dict[str, list]:
    """The columns of ``run_digests`` for a slice."""
    words, ids, starts = word_table(rows, plant)
    begin, end, period = find_runs(ids, starts)
    keep = ~repeats_in(len(ids), begin, end, period)
    texts = joined(words, starts, keep).to_pylist()
    bounds = np.searchsorted(begin, starts)
    out: dict[str, list] = {field.split()[0]: [] for field in DIGEST.split(", ")}
    out["doc_id"] = rows.column("doc_id").to_pylist()
    for row, text in enumerate(texts):
        own = slice(bounds[row], bounds[row + 1])
        found = list(zip((begin[own] - starts[row]).tolist(), (end[own] - begin[own]).tolist(), period[own].tolist()))
        start, length, q = min(found, key=lambda run: (-run[1], run[0], run[2])) if found else (None, None, None)
        out["n_runs"].append(len(found))
        out["start"].append(start)
        out["length"].append(length)
        out["period"].append(q)
        out["exponent_milli"].append(1000 * length // q if found else None)
        lines = "".join(f"{start},{length},{q}\n" for start, length, q in found)
        out["runs_sha256"].append(hashlib.sha256(lines.encode()).hexdigest())
        out["collapsed_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
    return out


def named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def run_digests(docs: DataFrame, plant: bool = True) -> DataFrame:
    """Per document the number of runs, the longest one, and hashes of all runs and of the text without their repeats.

    With ``plant`` one in ten documents, by a hash of the id, gets a run planted first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in map(str.split, DIGEST.split(", "))])
        for batch in batches:
            for rows in slices(batch):
                yield pa.RecordBatch.from_pydict(digest(rows, plant), schema)

    return named(docs).mapInArrow(run, DIGEST)


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """Every run of every document: ``doc_id, start, length, period`` in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                _, ids, starts = word_table(rows, False)
                begin, end, period = find_runs(ids, starts, least_length, least_exponent)
                row = np.searchsorted(starts, begin, "right") - 1
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id").take(pa.array(row)), "start": begin - starts[row],
                    "length": end - begin, "period": period})

    return named(docs).mapInArrow(run, "doc_id bigint, start bigint, length bigint, period bigint")


def without_repeats(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``doc_id`` and the text of its words outside the repeats of runs, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                words, ids, starts = word_table(rows, False)
                keep = ~repeats_in(len(ids), *find_runs(ids, starts, least_length, least_exponent))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"), "text": joined(words, starts, keep).cast(pa.string())})

    return named(docs).mapInArrow(run, "doc_id bigint, text string")
