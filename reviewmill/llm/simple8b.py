"""Simple-8b word-aligned packing with escapes and per-block offsets.

Every 64-bit word holds a 4-bit selector and as many ids as its selector packs
into 60 bits.  Ids are cut into blocks of ``BLOCK`` that start at a word of their
own, so packing and unpacking run over all blocks at once and any block can be
read alone.  An id of more than 60 bits is written as an escape: a word with
selector 0, then the id as a raw word.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
ESCAPE = 0
#: Ids per word and bits per id of selectors 1 to 14.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNTS = np.array([1, *(count for count, _ in PACKINGS), 0])


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of every block with the number of words at the end."""
    ids = np.asarray(ids).astype(np.uint64)
    size = len(ids)
    blocks = -(-size // BLOCK)
    padded = np.zeros(size + 64, np.uint64)
    padded[:size] = ids
    best = np.zeros(size, np.uint8)
    largest = int(ids.max()) if size else 0
    for selector in range(len(PACKINGS), 0, -1):
        count, bits = PACKINGS[selector - 1]
        if largest < 1 << bits:
            best[:] = selector
            continue
        over = np.zeros(size + 65, np.int32)
        np.cumsum(padded >= np.uint64(1 << bits), out=over[1:])
        best[over[count:count + size] == over[:size]] = selector
    steps = _COUNTS[best]
    at = np.arange(blocks) * BLOCK
    ends = np.minimum(at + BLOCK, size)
    visited = []
    while len(at):
        visited.append(at)
        at = at + steps[at]
        live = at < ends
        at, ends = at[live], ends[live]
    heads = np.sort(np.concatenate(visited)) if visited else np.zeros(0, np.int64)
    kinds = best[heads]
    places = np.cumsum(1 + (kinds == ESCAPE)) - 1 - (kinds == ESCAPE)
    words = np.zeros(int(places[-1]) + 1 + int(kinds[-1] == ESCAPE) if len(heads) else 0, np.uint64)
    limit = np.minimum((heads // BLOCK + 1) * BLOCK, size)
    for selector in np.unique(kinds):
        chosen = np.flatnonzero(kinds == selector)
        if selector == ESCAPE:
            words[places[chosen] + 1] = padded[heads[chosen]]
            continue
        count, bits = PACKINGS[selector - 1]
        packed = np.full(len(chosen), int(selector) << 60, np.uint64)
        for slot in range(count):
            where = heads[chosen] + slot
            packed |= np.where(where < limit[chosen], padded[where], np.uint64(0)) << np.uint64(slot * bits)
        words[places[chosen]] = packed
    offsets = np.append(places[np.searchsorted(heads, np.arange(blocks) * BLOCK)] if blocks else [], len(words))
    return words, offsets.astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray, size: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (exclusive; all by default) out of ``size`` packed ids."""
    last = len(offsets) - 1 if last is None else last
    base, stop = first * BLOCK, min(last * BLOCK, size)
    if stop <= base:
        return np.zeros(0, np.uint64)
    starts = offsets[first:last].astype(np.int64) - int(offsets[first])
    words = words[int(offsets[first]):int(offsets[last])]
    kinds = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, bool)
    for place in np.flatnonzero(kinds == ESCAPE):
        if not raw[place]:
            raw[place + 1] = True
    raw = raw[:len(words)]
    counts = np.where(raw, 0, _COUNTS[kinds])
    before = np.cumsum(counts) - counts
    block = np.searchsorted(starts, np.arange(len(words)), "right") - 1
    places = before - before[starts][block] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, stop - base)
    out = np.zeros(stop - base, np.uint64)
    for selector in np.unique(kinds[~raw]):
        chosen = np.flatnonzero((kinds == selector) & ~raw)
        if selector == ESCAPE:
            out[places[chosen]] = words[chosen + 1]
            continue
        count, bits = PACKINGS[selector - 1]
        for slot in range(count):
            where = places[chosen] + slot
            held = where < limit[chosen]
            out[where[held]] = (words[chosen[held]] >> np.uint64(slot * bits)) & np.uint64((1 << bits) - 1)
    return out
