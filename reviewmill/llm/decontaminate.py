"""Benchmark passages in documents by q-gram lemma filtering and banded alignment.

Texts are compared with letters A-Z lower-cased and white space as one space.
A region within ``e`` edits of a passage shares at least ``n - q e`` of the
passage's ``n`` q-gram places with it, all on diagonals at most ``e`` apart.
Shared 8-grams are counted per document, passage and diagonal band; bands are at
least ``2 e`` wide and overlap by half, so one of them holds the whole region.
What reaches the bound is verified by an alignment inside the band.

Benchmark items longer than ``WINDOW`` bytes are searched as windows that begin
every ``STRIDE`` bytes, so an unchanged run of ``WINDOW + STRIDE - 1`` bytes of a
long item is surely found, and shorter runs where they hold a window.
``edit_percent`` of a passage's length is its budget.  q-grams that stand in over
``OFTEN`` places of the benchmark are not counted, and every passage's bound is
lowered by its places with such q-grams, which keeps the lemma exact; a passage
whose bound would fall below one counts all its q-grams.  Where even that leaves
no bound (13 to 15 bytes, whose one edit can touch every 8-gram), 4-grams are
counted instead.

The benchmark is read in blocks of at most ``BLOCK_BYTES``; each block is one
pass over the documents.

Edits are counted on UTF-8 bytes, so a changed accented letter may count twice.

Edge cases: null or empty texts and items match nothing, items shorter than 8
characters are found as they are; null ``doc_id`` stays null; repeated rows give
repeated results; an empty table on either side gives no rows; other columns are
ignored; texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_ids import tidied
from .words import WHITE, buffer_of

Q, SHORT_Q = 8, 4
WINDOW, STRIDE = 200, 50
EDIT_PERCENT = 8
OFTEN = 8
BLOCK_BYTES = 4 << 20
PIECE = 1 << 20
RESULT = "doc_id bigint, item_id bigint, edits int, start bigint"


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with single spaces between the words of a row, and the rows' offsets."""
    data, offsets = buffer_of(column)
    white = WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    keep = ~white
    # Of a run of white space the first place stays, unless the row begins with it.
    keep[1:] |= white[1:] & ~white[:-1] & ~edge[1:-1]
    before = np.concatenate(([0], np.cumsum(keep)))
    places = before[offsets]
    data = np.where(white, np.uint8(32), data)[keep]
    # And not at the row's end.
    filled = places[1:] > places[:-1]
    last = places[1:][filled] - 1
    trailing = last[data[last] == 32]
    if len(trailing):
        stay = np.ones(len(data), bool)
        stay[trailing] = False
        places = np.concatenate(([0], np.cumsum(stay)))[places]
        data = data[stay]
    return data, places


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """Every ``q`` (4 or 8) bytes as one number."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint64) | (data[1:].astype(np.uint64) << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    return four if q == SHORT_Q else four[:-4] | (four[4:] << np.uint64(32))


class Passages:
    """The q-grams of a bounded block of benchmark passages."""

    def __init__(self, items: list[tuple[int, str]], edit_percent: int = EDIT_PERCENT, q: int = Q):
        self.q = q
        self.items: list[int] = []
        self.texts: list[np.ndarray] = []
        self.short: list[tuple[int, bytes]] = []
        tiny: list[tuple[int, str]] = []
        for item, text in items:
            data, _ = normalised(pa.array([text], pa.string()))
            if q == Q <= len(data) and len(data) - Q + 1 - Q * (len(data) * edit_percent // 100) < 1 and len(data) <= WINDOW:
                tiny.append((item, text))
                continue
            if len(data) < q:
                if len(data):
                    self.short.append((item, data.tobytes()))
                continue
            starts = [0] if len(data) <= WINDOW else [*range(0, len(data) - WINDOW, STRIDE), len(data) - WINDOW]
            for start in starts:
                self.items.append(item)
                self.texts.append(data[start:start + WINDOW])
        #: Passages that only shorter q-grams can find.
        self.tiny = Passages(tiny, edit_percent, SHORT_Q) if tiny else None
        all_grams = [grams(text, q) for text in self.texts]
        flat = np.concatenate(all_grams) if all_grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(all_grams)), [len(g) for g in all_grams])
        place = np.concatenate([np.arange(len(g)) for g in all_grams]) if all_grams else np.zeros(0, np.int64)
        _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rare = counts[inverse] <= OFTEN if len(flat) else np.zeros(0, bool)
        sizes = np.bincount(owner, minlength=len(all_grams))
        lengths = np.array([len(text) for text in self.texts], np.int64)
        self.budget = lengths * edit_percent // 100
        bound = np.bincount(owner, weights=rare, minlength=len(all_grams)).astype(np.int64) - q * self.budget
        plain = sizes - q * self.budget
        counted = rare | (bound < 1)[owner] if len(flat) else rare
        #: With no bound left, one shared q-gram is enough to be looked at.
        self.bound = np.maximum(np.where(bound >= 1, bound, plain), 1)
        self.width = np.array([1 << max(int(2 * e).bit_length(), 3) for e in self.budget], np.int64)
        order = np.argsort(flat[counted], kind="stable")
        self.grams, self.owner, self.place = flat[counted][order], owner[counted][order], place[counted][order]
        self.unique, self.first, self.count = np.unique(self.grams, return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._slot(self.unique)] = True

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shared q-grams: place in ``data``, passage, place in the passage."""
        found = []
        for at in range(0, len(data), PIECE):
            values = grams(data[at:at + PIECE + self.q - 1], self.q)
            maybe = np.flatnonzero(self.seen[self._slot(values)])
            if not len(self.unique) or not len(maybe):
                continue
            index = np.minimum(np.searchsorted(self.unique, values[maybe]), len(self.unique) - 1)
            same = self.unique[index] == values[maybe]
            where, index = maybe[same] + at, index[same]
            times = self.count[index]
            run = np.repeat(self.first[index] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            found.append((np.repeat(where, times), self.owner[run], self.place[run]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(parts) for parts in zip(*found))

    def regions(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """Row, passage and lowest diagonal of every band that reaches the passage's bound."""
        where, passage, place = self.hits(data)
        if not len(where):
            return []
        row = np.searchsorted(offsets, where, "right") - 1
        inside = where + self.q <= offsets[row + 1]
        where, passage, place, row = where[inside], passage[inside], place[inside], row[inside]
        # Diagonals from 0 on: a passage may hang over the row's start by its budget.
        diagonal = where - offsets[row] - place + WINDOW
        width = self.width[passage]
        found = set()
        # Rows and passages with fewer shared q-grams than the bound are out before any band is counted.
        passages = len(self.texts)
        key = row * passages + passage
        if (int(row[-1]) + 1) * passages <= 1 << 22:
            counts = np.bincount(key)[key]
        else:
            _, inverse, each = np.unique(key, return_inverse=True, return_counts=True)
            counts = each[inverse]
        enough = counts >= self.bound[passage]
        key, place, diagonal, width = key[enough], place[enough], diagonal[enough], width[enough]
        for half in (0, 1):
            band = (diagonal + half * width // 2) // width
            bands = int(band.max()) + 1 if len(band) else 1
            # One count per place of the passage, however often its q-gram stands in the band.
            places = np.unique((key * bands + band) * WINDOW + place) // WINDOW
            full, counts = np.unique(places, return_counts=True)
            for at in full[counts >= self.bound[full // bands % passages]].tolist():
                at, b = divmod(at, bands)
                r, p = divmod(at, passages)
                found.add((r, p, b * int(self.width[p]) - half * int(self.width[p]) // 2 - WINDOW))
        return sorted(found)

    def verify(self, text: np.ndarray, passage: int, low: int) -> tuple[int, int] | None:
        """Fewest edits between the passage and a region of ``text`` on the band's diagonals, and where the band starts."""
        wanted, width, budget = self.texts[passage], int(self.width[passage]), int(self.budget[passage])
        size, far = len(wanted), np.int32(1 << 20)
        near = max(low - budget, 0)
        same = text[near:low + width + budget + size].tobytes().find(wanted.tobytes())
        if same >= 0:  # the alignment without edits
            return 0, near + same
        # Column c of line i stands for text place i + low - budget + c: the band with room for its edits.
        columns = np.arange(width + 2 * budget + 1)
        base = low - budget
        cost = np.where((columns + base >= 0) & (columns + base <= len(text)), 0, far).astype(np.int32)
        for line in range(1, size + 1):
            ends = columns + base + line
            valid = (ends >= 0) & (ends <= len(text))
            chars = text[np.clip(ends - 1, 0, max(len(text) - 1, 0))] if len(text) else np.zeros(len(ends), np.uint8)
            step = cost + np.where((ends >= 1) & (chars == wanted[line - 1]), 0, 1)
            step[ends < 1] = far
            drop = np.append(cost[1:], far) + 1
            best = np.minimum(np.minimum(step, drop), far)
            best[~valid] = far
            best = np.minimum.accumulate(best - columns) + columns
            best[~valid] = far
            cost = best.astype(np.int32)
            if cost.min() > budget:
                return None
        edits = int(cost.min())
        return (edits, max(low, 0)) if edits <= budget else None

    def matches(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """Row, item, fewest edits, start in the normalised text; one per row and item."""
        data, offsets = normalised(column)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        if self.tiny:
            best = {(row, item): (edits, start) for row, item, edits, start in self.tiny.matches(column)}
        for row, passage, low in self.regions(data, offsets):
            key = (row, self.items[passage])
            if best.get(key, (1,))[0] == 0:
                continue
            found = self.verify(data[offsets[row]:offsets[row + 1]], passage, low)
            if found and (key not in best or found < best[key]):
                best[key] = found
        for item, raw in self.short:
            for row in range(len(column)):
                at = data[offsets[row]:offsets[row + 1]].tobytes().find(raw)
                if at >= 0:
                    best[row, item] = (0, at)
        return [(row, item, edits, start) for (row, item), (edits, start) in sorted(best.items())]


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in bounded blocks, read one partition after the other."""
    held, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text")
    for item, text in rows.distinct().toLocalIterator():
        if held and size + len(text) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += len(text)
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, edit_percent: int = EDIT_PERCENT) -> DataFrame:
    """``doc_id, item_id, edits, start`` for every document row and benchmark item found in it."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def search(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            passages = Passages(block, edit_percent)
            for batch in batches:
                for low in range(0, batch.num_rows, 256):
                    rows = batch.slice(low, 256)
                    found = passages.matches(rows.column("text"))
                    names = rows.column("doc_id")
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": names.take(pa.array([f[0] for f in found], pa.int64())),
                        "item_id": pa.array([f[1] for f in found], pa.int64()),
                        "edits": pa.array([f[2] for f in found], pa.int32()),
                        "start": pa.array([f[3] for f in found], pa.int64()),
                    })

        return texts.mapInArrow(tidied(run), RESULT)

    parts = [search(block) for block in blocks_of(benchmark)]
    return reduce(DataFrame.unionByName, parts) if parts else texts.sparkSession.createDataFrame([], RESULT)
