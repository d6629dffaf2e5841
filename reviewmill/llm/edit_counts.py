"""Token counts that follow edits without encoding a document again.

A document keeps its pre-tokens as the leaves of a segment tree of token counts
and lengths.  An edit touches the leaves whose text it changes and the one
before it, which may grow into the change; from there pre-tokens are cut anew
until a border meets an old border behind the edit.  Only these are encoded; the
sums above them are updated.  A text that holds an added token of the tokenizer
before or after its edits has no such leaves: both of its forms are encoded, and
all pre-tokens of the later one count as encoded again.

Edge cases: a null or empty text has 0 tokens and no edits; a null ``doc_id``
stays null; repeated rows give repeated results; an empty table gives no rows;
other columns are ignored; texts are used whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import BYTE_BPE, PieceEncoder

Edit = tuple[int, int, str]

PRE_TOKENS = regex.compile(public_tokenizers.PATTERN)
ROWS_AT_ONCE = 512
CACHE_ENTRIES = 500_000
RESULT = "doc_id bigint, n_tokens bigint, n_edits bigint, n_tokens_edited bigint, n_reencoded bigint"

#: What the clean-up replaces: mail addresses, keys behind a name, cloud access ids, long hex strings.
_PRIVATE = re.compile(
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|(?:password|passwd|token|secret)[ ]?=[ ]?\"?[^\s\"]+\"?"
    r"|AKIA[A-Z0-9]{16}|\b[0-9a-f]{32,}\b")


class CountTree:
    """Pre-token counts of one text under edits."""

    def __init__(self, text: str, count: Callable[[str], int], leaves: list[str] | None = None):
        self.text, self.count = text, count
        leaves = PRE_TOKENS.findall(text) if leaves is None else leaves
        #: The pre-tokens under a leaf: one at first, more or none after edits.
        self.held: dict[int, list[str]] = {}
        self.leaves = leaves
        self.reencoded = 0
        sizes = np.fromiter(map(len, leaves), np.int64, len(leaves))
        counts = np.fromiter(map(count, leaves), np.int64, len(leaves))
        self.levels = [np.stack([sizes, counts])]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            if below.shape[1] % 2:
                below = np.concatenate([below, np.zeros((2, 1), np.int64)], axis=1)
                self.levels[-1] = below
            self.levels.append(below[:, ::2] + below[:, 1::2])

    @property
    def total(self) -> int:
        return int(self.levels[-1][1].sum())

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The first leaf that ends at or behind ``position``, and where it starts."""
        index, start = 0, 0
        for level in reversed(self.levels[:-1]):
            index *= 2
            size = int(level[0, index])
            if start + size < position and index + 1 < level.shape[1]:
                start += size
                index += 1
        return index, start

    def _set(self, leaf: int, parts: list[str]) -> None:
        self.held[leaf] = parts
        change = np.array([sum(map(len, parts)), sum(map(self.count, parts))]) - self.levels[0][:, leaf]
        if change.any():
            for level in self.levels:
                level[:, leaf] += change
                leaf //= 2

    def apply(self, start: int, end: int, new: str) -> None:
        """Replace ``text[start:end]`` by ``new``; positions count in the text as it is now."""
        shift = len(new) - (end - start)
        # How a run of white space is cut depends on what follows the run.
        settled = start
        while settled and self.text[settled - 1].isspace():
            settled -= 1
        self.text = self.text[:start] + new + self.text[end:]
        if not self.leaves:
            self.__init__(self.text, self.count)
            self.reencoded += len(self.leaves)
            return
        first, at = self._leaf_at(settled)
        # Old borders behind the edit, from its first leaf on.
        leaf, border, old = first, at, []
        fresh: list[str] = []
        cut = at
        matches = PRE_TOKENS.finditer(self.text, at)
        while True:
            # Meet: a new border equals an old one behind the edit.
            while border < end or border + shift < cut:
                if leaf >= len(self.leaves):
                    break
                border += int(self.levels[0][0, leaf])
                old.append(leaf)
                leaf += 1
            if border >= end and border + shift == cut and cut >= start + len(new):
                break
            match = next(matches, None)
            if match is None:
                while leaf < len(self.leaves):
                    old.append(leaf)
                    leaf += 1
                break
            fresh.append(match.group())
            cut = match.end()
        self.reencoded += len(fresh)
        if not old:
            # Only an insertion at a border: it joins the leaf it stands in front of.
            old = [first]
            fresh += self.held.get(first, [self.leaves[first]]) if cut <= at + len(new) else []
        self._set(old[0], fresh)
        for other in old[1:]:
            self._set(other, [])


def cleanup_edits(text: str) -> list[Edit]:
    """Delete lines of over 20 characters that stood in the text before; replace private data.  In text order."""
    edits: list[Edit] = []
    seen: set[str] = set()
    at = 0
    for line in text.split("\n"):
        stop = at + len(line)
        if len(line) > 20 and line in seen:
            edits.append((max(at - 1, 0), stop, ""))
        else:
            seen.add(line)
            edits += [(at + hit.start(), at + hit.end(), "[removed]") for hit in _PRIVATE.finditer(line)]
        at = stop + 1
    return edits


class Counts(dict):
    """Tokens of pre-tokens; one that is not known is encoded."""

    def __init__(self, encoder: PieceEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> int:
        self[piece] = found = len(self.encoder.tokenizer.encode(piece, add_special_tokens=False).ids)
        return found

    def learn(self, leaves: list[list[str]]) -> None:
        """Count the new pre-tokens that begin with a space with one call."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        wanted: set[str] = set()
        for part in leaves:
            wanted.update(part)
        spaced = [piece[1:] for piece in wanted.difference(self) if piece[0] == " " and not piece[1:2].isspace() and len(piece) > 1]
        found: dict[str, bytes] = {}
        self.encoder._encode_new(spaced, found)
        self.update((" " + piece, len(ids) // 4) for piece, ids in found.items())


def counted(text: str, edits: list[Edit], counts: Counts, leaves: list[str] | None = None) -> tuple[int, int, int]:
    """Tokens before, tokens after ``edits`` (apart, in text order), pre-tokens encoded for the edits."""
    changed, at = [], 0
    for start, end, new in edits:
        changed += [text[at:start], new]
        at = end
    encoder, edited = counts.encoder, "".join([*changed, text[at:]])
    if encoder.added.search(text) or encoder.added.search(edited):
        again = sum(len(PRE_TOKENS.findall(part)) for part in encoder.added.split(edited)) + len(encoder.added.findall(edited))
        return len(encoder.whole(text)) // 4, len(encoder.whole(edited)) // 4, again if edits else 0
    tree = CountTree(text, counts.__getitem__, leaves)
    before = tree.total
    for start, end, new in reversed(edits):
        tree.apply(start, end, new)
    return before, tree.total, tree.reencoded


@lru_cache(maxsize=4)
def worker_counts(tokenizer: str) -> Counts:
    """One cache per worker process, so that it outlives a task."""
    return Counts(PieceEncoder(tokenizer))


def edited_counts(docs: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """Counts of ``docs(doc_id, text)`` before and after the clean-up edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = worker_counts(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(low, ROWS_AT_ONCE)
                texts = [text or "" for text in rows.column("text").to_pylist()]
                leaves = [PRE_TOKENS.findall(text) for text in texts]
                counts.learn(leaves)
                edits = [cleanup_edits(text) for text in texts]
                results = [counted(*document) for document in zip(texts, edits, [counts] * len(texts), leaves)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"),
                    "n_tokens": pa.array([r[0] for r in results], pa.int64()),
                    "n_edits": pa.array([len(change) for change in edits], pa.int64()),
                    "n_tokens_edited": pa.array([r[1] for r in results], pa.int64()),
                    "n_reencoded": pa.array([r[2] for r in results], pa.int64()),
                })

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, RESULT)
