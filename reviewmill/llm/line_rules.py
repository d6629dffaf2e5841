"""Line-first cleaning: rules judge every line, failing lines go, and a text that loses too much is rejected.

The rules, each on one line of a text (lines without words stay and are not judged):

* punctuation: no word ends a sentence, or more than a third of the words end in
  two or more ornaments (``SHOUTED!!``, ``word***``);
* navigation: at least two words are nothing but separators (``Home | News | About``)
  and at least one word in four is;
* boilerplate: a line of at most ``BOILERPLATE_WORDS`` words holds one of the
  ``PHRASES`` of licenses, cookie notices and the like.

A text is rejected when the removed lines hold more than ``LOST`` percent of its
words, or when the base measures fail: under 20 words, or more than 30 percent
of the words inside eight-word windows that the text has twice or more.  Hashes only
find the windows worth a look; those are compared word by word.

Edge cases: null and empty texts have no words, fail the base and keep their
null or empty text; a text in one line is judged as that line; repeated rows and
null ids give a row each; an empty table gives no rows; other columns are
ignored by ``line_verdicts`` and passed on by ``clean_texts``; texts are used whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_ids import mix, numbers_of, slices, split_words

LEAST_WORDS = 20
WINDOW = 8
REPEATED = 30
LOST = 50
BOILERPLATE_WORDS = 25

# Marks and phrases of the rules.
SYMBOLS = "#*$%&|<>"
ORNAMENTS = "!?#*$%&|<>"
SEPARATORS = "|<>/»«›‹·•"
ENDINGS = ".!?…。！？"
CLOSERS = "\"'”’»)]"
PHRASES = [
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "use of cookies", "uses cookies", "we use cookies", "enable javascript", "lorem ipsum", "sign in",
    "sign up", "log in", "read more", "click here", "skip to content", "back to top", "share this", "subscribe to our",
]
BLANKS = " \t\n\x0b\x0c\r"
WHITE = r"[\x20\x09-\x0D]"

SENTENCE_END = f"[{re.escape(ENDINGS)}][{re.escape(CLOSERS)}]*(?:{WHITE}|$)"
ORNATE_END = f"[{re.escape(ORNAMENTS)}]{{2,}}(?:{WHITE}|$)"

_sentence, _ornate = re.compile(SENTENCE_END), re.compile(ORNATE_END)
_only_separators = re.compile(f"[{re.escape(SEPARATORS)}]+")

VERDICTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, " \
    "base_failed boolean, kept boolean, n_lines_removed bigint, n_words_removed bigint"


def line_fault(line: str, size: int) -> str | None:
    """The rule that a line of ``size`` words breaks."""
    ends = line.rstrip(BLANKS).rstrip(CLOSERS)[-1:] in ENDINGS or _sentence.search(line)
    if not ends or 3 * len(_ornate.findall(line)) > size:
        return "punctuation"
    if any(mark in line for mark in SEPARATORS):
        marks = sum(1 for word in line.encode().split() if _only_separators.fullmatch(word.decode()))
        if marks >= 2 and 4 * marks >= size:
            return "navigation"
    if size <= BOILERPLATE_WORDS:
        lowered = line.lower()
        if any(phrase in lowered for phrase in PHRASES):
            return "boilerplate"
    return None


def repeated_words(ids: np.ndarray, starts: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Per text, how many words lie in windows of ``size`` words that it holds twice or more."""
    counts = np.diff(starts)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(max(len(ids) - size + 1, 0))
    at = at[at + size <= starts[1:][owner[at]]]
    hashes = mix(owner[at] + 1)
    words = mix(ids + 1)
    for step in range(size):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + words[at + step]
    in_order = np.sort(hashes)
    twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    if not len(twice):
        return np.zeros(len(counts), np.int64)
    at = at[twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes]
    # The windows left are told apart by their words: every step numbers the windows by one word more.
    number, width = owner[at], int(ids.max()) + 1
    for step in range(size):
        number = np.unique(number * width + ids[at + step], return_inverse=True)[1]
    found = at[np.bincount(number)[number] > 1]
    edges = np.zeros(len(owner) + 1, np.int64)
    np.add.at(edges, found, 1)
    np.add.at(edges, found + size, -1)
    return np.bincount(owner[np.cumsum(edges[:-1]) > 0], minlength=len(counts))


def judge(column: pa.Array, lost: int = LOST) -> tuple[dict[str, list], list[str | None]]:
    """Measures and verdicts of a column of texts, and the texts without the failing lines."""
    texts = column.to_pylist()
    words, starts = split_words(column)
    out: dict[str, list] = {field.split()[0]: [] for field in VERDICTS.split(", ")}
    out["n_words"] = np.diff(starts).tolist()
    out["n_repeat_words"] = repeated_words(numbers_of(words), starts).tolist()
    cleaned: list[str | None] = []
    for text, n_words, repeats in zip(texts, out["n_words"], out["n_repeat_words"]):
        held = text or ""
        left, seen, doubles, removed, removed_words = [], set(), 0, 0, 0
        for line in held.split("\n"):
            size = len(line.encode().split())
            if size:
                doubles += line in seen
                seen.add(line)
                if line_fault(line, size):
                    removed += 1
                    removed_words += size
                    continue
            left.append(line)
        failed = n_words < LEAST_WORDS or 100 * repeats > REPEATED * n_words
        out["word_chars"].append(len(held) - sum(held.count(mark) for mark in BLANKS))
        out["n_symbols"].append(sum(held.count(mark) for mark in SYMBOLS))
        out["n_dup_lines"].append(doubles)
        out["base_failed"].append(failed)
        out["kept"].append(not failed and 100 * removed_words <= lost * n_words)
        out["n_lines_removed"].append(removed)
        out["n_words_removed"].append(removed_words)
        cleaned.append(text if not removed else "\n".join(left))
    return out, cleaned


def line_verdicts(docs: DataFrame, lost: int = LOST) -> DataFrame:
    """``doc_id``, the measures, ``base_failed``, ``kept`` and what the rules removed, for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), **judge(rows.column("text"), lost)[0]})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, f"doc_id bigint, {VERDICTS}")


def clean_texts(docs: DataFrame, lost: int = LOST) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; ``text`` is without the removed lines."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                measures, texts = judge(rows.column("text"), lost)
                cleaned = pa.array(texts, rows.schema.field(place).type)
                yield rows.set_column(place, rows.schema.field(place), cleaned).filter(pa.array(measures["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
