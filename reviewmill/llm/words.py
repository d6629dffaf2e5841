"""Words and shingles of whole Arrow text columns, hashed with array arithmetic.

A word's hash is a sum of table entries times powers of an odd base, read off a
running sum, so no text is cut into Python strings.  Very long texts are worked
in pieces that end at white space; they are never shortened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SHINGLE_WORDS = 5

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Everything but letters: bytes above 127 count as letters.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[128:] = False
NOT_LETTERS[97:123] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_SLOTS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        for at, factor in enumerate((BASE, INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[at] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of a text column (null: empty) and the offset of every row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return LOWER[raw], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``PIECE`` bytes that end at a row's end or a breaking byte."""
    at, total = 0, len(data)
    while at < total:
        end = min(at + PIECE, total)
        if end < total:
            row_end = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            gaps = np.flatnonzero(breaks[data[max(at, end - 4096):end]])
            cut = max(row_end, max(at, end - 4096) + int(gaps[-1]) + 1 if len(gaps) else 0)
            if cut <= at:
                later = int(offsets[np.searchsorted(offsets, end, "left")])
                gap = breaks[data[end:later]].argmax() if later > end else 0
                cut = end + int(gap) + 1 if later > end and breaks[data[end + gap]] else later
            end = cut
        yield at, end
        at = end


def word_hashes(column: pa.Array, breaks: np.ndarray = WHITE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hash of every word in row order, the row of each, and the hashes of the words' first bytes.

    ``prefixes`` asks for hashes of the first so many bytes; words without more bytes than that get 0.
    """
    data, offsets = buffer_of(column)
    found, rows, heads = [], [], [[] for _ in prefixes]
    for at, end in pieces(data, offsets, breaks):
        part = data[at:end]
        inside = np.empty(len(part) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(breaks[part], out=inside[1:-1])
        edge = np.zeros(len(part) + 1, bool)
        low, high = np.searchsorted(offsets, [at, end])
        edge[offsets[low:high] - at] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        if not len(starts):
            continue
        power, inverse = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * power[:len(part)], out=sums[1:])
        back = inverse[starts]
        found.append(mix((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64)))
        rows.append(np.searchsorted(offsets, starts + at, "right") - 1)
        for size, out in zip(prefixes, heads):
            long = ends - starts > size
            upto = np.where(long, starts + size, starts)
            out.append(np.where(long, mix((sums[upto] - sums[starts]) * back + np.uint64(1000 + size)), np.uint64(0)))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(found, np.uint64), join(rows, np.int64), [join(out, np.uint64) for out in heads]


def shingle_sets(column: pa.Array, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct ``size``-word shingle hashes of every row.

    A row with fewer words has its whole sequence as one shingle, a row without words none.
    """
    words, rows, _ = word_hashes(column)
    counts = np.bincount(rows, minlength=len(column))
    starts = np.concatenate(([0], np.cumsum(counts)))
    full = max(len(words) - size + 1, 0)
    joined = np.zeros(full, np.uint64)
    for step in range(size):
        joined += words[step:step + full] * _SLOTS[step]
    joined = mix(joined)
    for row in range(len(column)):
        first, count = starts[row], counts[row]
        if count >= size:
            yield np.unique(joined[first:first + count - size + 1])
        elif count:
            short = (words[first:first + count] * _SLOTS[:count]).sum(dtype=np.uint64) + np.uint64(count)
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
