"""Toxicity scores from a factorization machine over hashed terms.

Terms are a text's distinct words of letters, and the first 4, 5 and 6 bytes of
longer words, so that inflected forms share what they begin with.  The terms that
tell the labels apart best are kept, by a chi-square over the training rows; the
machine gives each a weight and a vector, so that two terms together can count
for more or less than their sum (an insult next to a group mention).

Fitted on at most ``SAMPLE`` labelled rows, the first by a hash of the id, so the
sample is the same in every run.  Everything else runs over all rows.

Edge cases: null or empty texts, and texts without known terms, get the score of
no terms; rows without a label, with a null label or with labels that disagree
are not trained on; without labelled rows of both classes every score is the
share of class 1 (0 without any rows); a null ``doc_id`` is not held out and not
trained on; repeated rows give repeated scores; an empty table gives no rows;
other columns are ignored; texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .word_ids import tidied
from .words import NOT_LETTERS, mix, word_hashes

SAMPLE = 16_000
TERMS, FACTORS = 1536, 6
HASH_BITS = 21
STEPS, RATE, DECAY = 160, 0.05, 2e-4
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
ROWS_AT_ONCE = 256


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def term_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed terms of every row: rows and buckets."""
    words, rows, heads = word_hashes(column, NOT_LETTERS, PREFIXES)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = np.concatenate([words, *(mix(head) for head in heads)])
    owner = np.concatenate([rows] * (1 + len(heads)))
    real = np.concatenate([np.ones(len(words), bool), *(head != 0 for head in heads)])
    buckets = (every[real] >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    both = np.unique((owner[real] << HASH_BITS) | buckets)
    return both >> HASH_BITS, both & ((1 << HASH_BITS) - 1)


class Machine:
    """A fitted factorization machine: kept buckets in order, bias, weights, vectors."""

    def __init__(self, kept: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.kept, self.bias, self.weights, self.vectors = kept, bias, weights, vectors

    def dense(self, rows: np.ndarray, buckets: np.ndarray, size: int) -> np.ndarray:
        found = np.zeros((size, len(self.kept)), np.float32)
        if len(self.kept) and len(buckets):
            at = np.minimum(np.searchsorted(self.kept, buckets), len(self.kept) - 1)
            same = self.kept[at] == buckets
            found[rows[same], at[same]] = 1.0
        return found

    def logits(self, features: np.ndarray) -> np.ndarray:
        mixed = features @ self.vectors
        pairs = 0.5 * (mixed ** 2 - features @ self.vectors ** 2).sum(axis=1)
        return self.bias + features @ self.weights + pairs

    def scores(self, column: pa.Array) -> np.ndarray:
        rows, buckets = term_rows(column)
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(self.dense(rows, buckets, len(column))), -30, 30).astype(np.float64)))


def strength(seen: np.ndarray, positive: np.ndarray, rows: int, share: float) -> np.ndarray:
    """Chi-square of every term against the labels, with a correction for small counts."""
    spread = seen * share * (1 - share) * (1 - seen / max(rows, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((seen >= 2) & (spread > 0), (np.abs(positive - seen * share) - 0.5).clip(0) ** 2 / spread, 0.0)


def telling_terms(buckets: np.ndarray, values: np.ndarray, count: int = TERMS) -> np.ndarray:
    """The ``count`` strongest buckets, in bucket order; of equals the lower ones."""
    best = np.lexsort((buckets, -values))[:count]
    return np.sort(buckets[best][values[best] > 0])


def descend(kept: np.ndarray, features: np.ndarray, labels: np.ndarray) -> Machine:
    """Full-batch Adam on the logistic loss; one column of ``features`` for every kept bucket, labels 0 and 1."""
    labels = labels.astype(np.float32)
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0.0 < share < 1.0:
        edge = 30.0 if share else -30.0
        return Machine(np.zeros(0, np.int64), edge, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    random = np.random.Generator(np.random.PCG64(7))
    state = [np.array([np.log(share / (1 - share))], np.float32), np.zeros(len(kept), np.float32),
             random.normal(0, 0.05, (len(kept), FACTORS)).astype(np.float32)]
    machine = Machine(kept, float(state[0][0]), state[1], state[2])
    means, squares = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    for step in range(1, STEPS + 1):
        error = 1.0 / (1.0 + np.exp(-np.clip(machine.logits(features), -30, 30))) - labels
        error = (error / len(labels)).astype(np.float32)
        mixed, linear = features @ machine.vectors, features.T @ error
        slope = [np.array([error.sum()], np.float32), linear + DECAY * machine.weights,
                 features.T @ (error[:, None] * mixed) - linear[:, None] * machine.vectors + DECAY * machine.vectors]
        for at, part in enumerate(slope):
            means[at] = 0.9 * means[at] + 0.1 * part
            squares[at] = 0.999 * squares[at] + 0.001 * part ** 2
            state[at] = state[at] - RATE * (means[at] / (1 - 0.9 ** step)) / (np.sqrt(squares[at] / (1 - 0.999 ** step)) + 1e-8)
        machine.bias, machine.weights, machine.vectors = float(state[0][0]), state[1], state[2]
    return machine


def fit(column: pa.Array, labels: np.ndarray) -> Machine:
    """Fit on rows in memory; ``fit_on`` is the same over tables."""
    rows, buckets = term_rows(column)
    share = float(labels.mean()) if len(labels) else 0.0
    seen = np.bincount(buckets, minlength=1 << HASH_BITS)
    values = strength(seen, np.bincount(buckets, weights=labels[rows], minlength=1 << HASH_BITS), len(labels), share)
    kept = telling_terms(np.arange(1 << HASH_BITS), values)
    blank = Machine(kept, 0.0, np.zeros(len(kept)), np.zeros((len(kept), FACTORS)))
    return descend(kept, blank.dense(rows, buckets, len(labels)), labels)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows ``text, toxic`` outside the held-out fold, by a hash of the id."""
    agreed = labels.where("doc_id is not null and toxic is not null and toxic in (0, 1)").groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("toxic").alias("low"), F.max("toxic").alias("high")) \
        .where("low = high")
    order = F.xxhash64(F.lit(17), "doc_id")
    chosen = agreed.where(fold_of(F.col("doc_id")) != HELD_OUT).orderBy(order, "doc_id").limit(sample)
    # At most ``sample`` ids, so they can go to every executor and no text is shuffled but the sample's.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # Of several texts of one id the smallest, so that every run fits the same machine.
    return texts.join(F.broadcast(chosen.select("doc_id", F.col("low").alias("toxic"))), "doc_id") \
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on the sample: Spark counts its terms and finds each row's kept ones, the driver gets those alone."""
    rows = stored(training_rows(docs, labels, sample), "training-rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, positive = np.zeros(1 << HASH_BITS, np.int64), np.zeros(1 << HASH_BITS, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(low, ROWS_AT_ONCE)
                owner, buckets = term_rows(part.column("text"))
                seen += np.bincount(buckets, minlength=len(seen))
                positive += np.bincount(buckets[part.column("toxic").to_numpy()[owner] == 1], minlength=len(seen))
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": found, "seen": seen[found], "positive": positive[found]})

    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.avg("toxic"), F.lit(0.0)).alias("share")).first()
    share, least = total["share"], F.col("seen") * (1 - F.col("seen") / max(total["rows"], 1))
    # The order of ``strength``, so that only the strongest buckets come to the driver.
    force = F.pow(F.greatest(F.abs(F.col("positive") - F.col("seen") * share) - 0.5, F.lit(0.0)), 2) / (least * share * (1 - share))
    counts = rows.select("text", "toxic").mapInArrow(tidied(count), "bucket bigint, seen bigint, positive bigint") \
        .groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("positive").alias("positive"))
    top = counts.where((F.col("seen") >= 2) & (least > 0)).orderBy(force.desc(), "bucket").limit(TERMS).toPandas() \
        if 0 < share < 1 else pd.DataFrame({"bucket": [], "seen": [], "positive": []}, dtype=np.int64)
    values = strength(top["seen"].to_numpy(), top["positive"].to_numpy(), total["rows"], share)
    kept = telling_terms(top["bucket"].to_numpy(), values)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(low, ROWS_AT_ONCE)
                owner, buckets = term_rows(part.column("text"))
                at = np.minimum(np.searchsorted(kept, buckets), max(len(kept) - 1, 0))
                same = kept[at] == buckets if len(kept) else np.zeros(len(buckets), bool)
                ends = np.cumsum(np.bincount(owner[same], minlength=part.num_rows))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(at[same], pa.int32()))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "toxic": part.column("toxic"), "terms": lists})

    found = rows.mapInArrow(tidied(keep), "doc_id bigint, toxic int, terms array<int>").toArrow().sort_by("doc_id")
    features = np.zeros((found.num_rows, len(kept)), np.float32)
    lists = found.column("terms").combine_chunks()
    owner = np.repeat(np.arange(found.num_rows), np.diff(lists.offsets.to_numpy()))
    features[owner, lists.values.to_numpy()[lists.offsets[0].as_py():lists.offsets[-1].as_py()]] = 1.0
    return descend(kept, features, found.column("toxic").to_numpy())


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    machine = fit_on(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(low, ROWS_AT_ONCE)
                yield rows.filter(pa.array(machine.scores(rows.column("text")) < threshold))

    return docs.mapInArrow(tidied(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``."""
    machine = fit_on(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(low, ROWS_AT_ONCE)
                scores = machine.scores(rows.column("text"))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "score": pa.array(scores),
                    "predicted": pa.array((scores >= threshold).astype(np.int32))})

    number = F.col("doc_id").cast("bigint")
    held = F.coalesce(fold_of(number) == HELD_OUT, F.lit(False))
    return docs.select(number.alias("doc_id"), "text", held.alias("held_out")).mapInArrow(
        tidied(run), "doc_id bigint, held_out boolean, score double, predicted int")
