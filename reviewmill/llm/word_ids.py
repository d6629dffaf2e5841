"""Words of whole texts as numbers, a bounded number of bytes at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts worked at once; a longer text is worked alone.
BYTES_AT_ONCE = 1 << 21


def slices(batch: pa.RecordBatch, name: str = "text", most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows with about ``most`` bytes of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0), np.int64)
    ends = np.cumsum(sizes)
    low = 0
    while low < batch.num_rows:
        spent = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, spent + most, "right")), low + 1)
        yield batch.slice(low, high - low)
        low = high


def give_back() -> None:
    """Return freed memory to the system; workers live on between tasks and stages, next to each other on one machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidied(run: Kernel) -> Kernel:
    """The kernel, giving back memory now and then and at its task's end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(run(batches), 1):
            yield batch
            if number % 16 == 0:
                give_back()
        give_back()

    return wrapped


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts in a row (null has none), and where every text starts (one entry more)."""
    lists = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
    words = lists.flatten()
    ends = np.asarray(pc.cumulative_sum(pc.list_value_length(lists)), np.int64) if len(column) else np.zeros(0, np.int64)
    # White space at either end of a text leaves an empty word.
    real = np.asarray(pc.not_equal(pc.binary_length(words), 0), bool)
    before = np.concatenate(([0], np.cumsum(real)))
    return words.filter(pa.array(real)), before[np.concatenate(([0], ends))].astype(np.int64)


def numbers_of(words: pa.Array) -> np.ndarray:
    """A number for every word, equal for equal words."""
    return np.asarray(words.dictionary_encode().indices, np.int64)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = values.astype(np.uint64)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return values ^ (values >> np.uint64(32))


def strings(column: pa.Array) -> list[str]:
    """The texts of a column without nulls."""
    return column.to_numpy(zero_copy_only=False).tolist()


def outer_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of every text of a column without nulls; 0 for an empty one."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.append(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.uint8(0))
    empty = ends[1:] == ends[:-1]
    return np.where(empty, 0, raw[ends[:-1]]), np.where(empty, 0, raw[ends[1:] - 1])
