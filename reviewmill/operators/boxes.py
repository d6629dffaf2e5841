"""Joins of vectors by distance where every row knows how far it has to look.

A tree of cuts, learned from a bounded sample, puts the vectors into boxes of a
few hundred rows.  A row is sent only to the boxes that its own reach touches,
so in few dimensions the work grows with the rows and not with their square;
where vectors do not separate, a row meets every box, in units of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, lookup, stored
from .blocks import distances

BOX_ROWS = 512
MAX_DEPTH = 12
#: Sampled rows for each box.
SAMPLE_ROWS = 16
#: Visitors of a box that are worked in one group.
VISITORS = 1 << 14
#: Distances held at once.
GAPS_AT_ONCE = 1 << 20


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column, one a row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def chunks(rows: int, others: int) -> Iterator[slice]:
    """Stretches of rows whose distances to all others fit in memory."""
    step = max(1, GAPS_AT_ONCE // max(others, 1))
    return (slice(low, min(low + step, rows)) for low in range(0, rows, step))


class Cuts:
    """A full binary tree: node ``i`` cuts an axis, its children are ``2 i + 1`` and ``2 i + 2``; the leaves are boxes."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axes, self.at = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        parts = {0: sample}
        for node in range(len(self.axes)):
            part = parts.pop(node)
            if len(part):
                self.axes[node] = np.ptp(part, axis=0).argmax()
                self.at[node] = np.median(part[:, self.axes[node]])
            right = part[:, self.axes[node]] > self.at[node]
            parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]

    def box(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axes[node]] > self.at[node])
        return node - len(self.axes)


class Bounds:
    """The least and the largest of every axis in every node of the tree."""

    def __init__(self, cuts: Cuts, low: np.ndarray, high: np.ndarray):
        self.cuts = cuts
        inner = len(cuts.axes)
        self.low = np.concatenate((np.full((inner, low.shape[1]), np.inf), low))
        self.high = np.concatenate((np.full((inner, low.shape[1]), -np.inf), high))
        for node in range(inner - 1, -1, -1):
            self.low[node] = self.low[2 * node + 1:2 * node + 3].min(axis=0)
            self.high[node] = self.high[2 * node + 1:2 * node + 3].max(axis=0)

    def touched(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the boxes within their reach; bounds are a little wider, so that no rounding loses a box."""
        row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for level in range(self.cuts.depth + 1):
            if level:
                row, node = np.repeat(row, 2), np.repeat(2 * node + 1, 2)
                node[1::2] += 1
            gap = np.zeros(len(row))
            for axis in range(points.shape[1]):
                own = points[row, axis]
                gap += np.maximum(np.maximum(self.low[node, axis] - own, own - self.high[node, axis]), 0.0) ** 2
            near = np.sqrt(gap) <= reach[row] * (1 + 1e-9) + 1e-9
            row, node = row[near], node[near]
        return row, node - len(self.cuts.axes)


@dataclass
class Boxes:
    """Vectors with the boxes they are in."""

    rows: DataFrame
    bounds: Bounds


def boxed(vectors: DataFrame, box_rows: int | None = None) -> Boxes:
    """``vectors(id, vector, ...)`` with their ``box``; only the sample and one row of bounds a box reach the driver."""
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(vectors.count(), 1) / (box_rows or BOX_ROWS)))))
    sample = vectors.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS << depth).select("vector").toArrow()
    points = matrix(sample.column("vector"))
    if not len(points):
        raise ValueError("no vectors")
    cuts = Cuts(points, depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("box", pa.array(cuts.box(matrix(batch.column("vector"))).astype(np.int32)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields) + ", box int"
    rows = checkpointed(vectors.mapInArrow(place, schema))
    axes = range(points.shape[1])
    found = rows.groupBy("box").agg(*[side(F.get("vector", F.lit(axis)).cast("double")).alias(f"{name}_{axis}")
                                      for name, side in (("low", F.min), ("high", F.max)) for axis in axes]).toArrow()
    boxes = found.column("box").to_numpy()
    low, high = np.full((1 << depth, len(axes)), np.inf), np.full((1 << depth, len(axes)), -np.inf)
    for axis in axes:
        low[boxes, axis], high[boxes, axis] = found.column(f"low_{axis}").to_numpy(), found.column(f"high_{axis}").to_numpy()
    return Boxes(rows, Bounds(cuts, low, high))


def visits(boxes: Boxes, rows: DataFrame, reach: Column, onward: bool = False, home: bool = True) -> DataFrame:
    """The rows once for every box within their reach; ``onward`` leaves out boxes before their own, not ``home`` their own."""
    asked, bounds = rows.withColumn("_reach", reach.cast("double")), boxes.bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                row, box = bounds.touched(matrix(part.column("vector")), np.asarray(part.column("_reach"), np.float64))
                own = np.asarray(part.column("box"))[row]
                kept = (box > own) | (home & (box == own)) | ((not onward) & (box < own))
                sent = part.drop_columns(["_reach", "box"]).take(pa.array(row[kept]))
                yield sent.append_column("box", pa.array(box[kept].astype(np.int32)))

    fields = [f for f in rows.schema.fields if f.name != "box"]
    return asked.select(*[f.name for f in fields], "_reach", "box").mapInArrow(
        run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", box int")


def meet(visitors: DataFrame, members: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run a kernel on visitors and members of every box, with at most about ``VISITORS`` visitors at once."""
    visitors = stored(visitors, "visits")
    parts = lookup(visitors.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / F.lit(VISITORS)).cast("int").alias("parts")))
    asking = visitors.join(parts, "box").withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int")).drop("parts")
    asked = members.join(parts, "box").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # Fresh column identities, as both sides may come from the same rows.
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])
    return asking.groupBy("box", "part").cogroup(asked.groupBy("box", "part")).applyInArrow(kernel, schema)


# -- nearest rows ------------------------------------------------------------

def _exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distances of every row of ``left`` to its own rows of ``right``, axis by axis."""
    total = np.zeros(right.shape[:2])
    for axis in range(left.shape[1]):
        total += (left[:, axis][:, None] - right[:, :, axis]) ** 2
    return np.sqrt(total)


def _first_gaps(own: np.ndarray, others: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` smallest distances of every row, a vector counting as often as it occurs; infinite where there are fewer."""
    result = np.full((len(own), k), np.inf)
    take = min(k, len(others))
    for part in chunks(len(own), len(others)):
        gaps = distances(own[part], others)
        near = np.argpartition(gaps, take - 1, axis=1)[:, :take] if take < len(others) else np.tile(np.arange(take), (len(gaps), 1))
        gaps = _exact(own[part], others[near])
        order = np.argsort(gaps, axis=1, kind="stable")
        gaps, often = np.take_along_axis(gaps, order, 1), np.take_along_axis(np.minimum(copies[near], k), order, 1)
        ends = np.cumsum(often, axis=1)
        for place in range(k):
            at = (ends <= place).sum(axis=1)
            some = at < take
            result[part][some, place] = gaps[some, at[some]]
    return result


def nearest_gaps(unique: DataFrame, k: int, box_rows: int | None = None) -> DataFrame:
    """``id, gaps``: the ``k`` smallest distances of every vector of ``unique(id, vector, copies)`` to all rows, its own
    among them, in order; fewer where there are fewer rows.

    The rows of its own box bound how far a vector has to look.
    """
    boxes = boxed(unique.select("id", "vector", "copies"), box_rows)

    def listed(gaps: np.ndarray, kept: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], kept.sum(axis=1).cumsum())), pa.int32()), pa.array(gaps[kept]))

    def at_home(table: pa.Table) -> pa.Table:
        points, copies = matrix(table.column("vector")), table.column("copies").to_numpy()
        gaps = _first_gaps(points, points, copies, k)
        return table.append_column("gaps", listed(gaps, np.isfinite(gaps))).append_column("bound", pa.array(gaps[:, -1]))

    kind = boxes.rows.schema["vector"].dataType.simpleString()
    home = stored(boxes.rows.groupBy("box").applyInArrow(
        at_home, f"id bigint, vector {kind}, copies bigint, box int, gaps array<double>, bound double"), "home")

    def away(visitors: pa.Table, members: pa.Table) -> pa.Table:
        bound = visitors.column("bound").to_numpy()
        gaps = np.empty((0, k))
        if visitors.num_rows and members.num_rows:
            gaps = _first_gaps(matrix(visitors.column("vector")), matrix(members.column("vector")), members.column("copies").to_numpy(), k)
        kept = np.isfinite(gaps) & (gaps < bound[:len(gaps), None])
        some = np.flatnonzero(kept.any(axis=1))
        return pa.table({"id": visitors.column("id").take(pa.array(some)), "gaps": listed(gaps[some], kept[some])})

    visitors = visits(boxes, home.select("id", "vector", "bound", "box"), F.col("bound"), home=False)
    found = meet(visitors, boxes.rows, away, "id bigint, gaps array<double>")
    return home.select("id", "gaps").unionByName(found).groupBy("id").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("gaps"))), 1, k).alias("gaps"))
