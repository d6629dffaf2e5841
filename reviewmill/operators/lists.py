"""Approximate neighbours for tables of any size: inverted lists around trained centroids.

About the square root of the number of vectors many lists: a first level of
centroids is trained on a bounded sample, a second one inside every cell of the
first.  All vectors are dealt to lists.  A query visits the ``probe`` lists whose
centroids are nearest to it, and further ones until they hold enough vectors, so
no answer is short; inside the lists scores are exact.  Lists and their queries
are cut into tiles, so a crowded list is many tasks; equal vectors are one.

The centroids and the size of every list come to the driver: for a billion
vectors some thirty thousand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .blocks import CHUNK, distinct_vectors, matrix, with_copies
from .ordered import top_per_group

SAMPLE = 20_000
ROUNDS = 10
TILE = 4096


def centres(points: np.ndarray, count: int, random: np.random.Generator) -> np.ndarray:
    """K-means centres; fewer if there are fewer different points."""
    distinct = np.unique(points, axis=0)
    found = distinct[random.choice(len(distinct), min(count, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        own = nearest_centre(points, found)
        sums, sizes = np.zeros_like(found), np.bincount(own, minlength=len(found))
        np.add.at(sums, own, points)
        found = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], found)
    return found


def nearest_centre(points: np.ndarray, found: np.ndarray) -> np.ndarray:
    return (points @ found.T - 0.5 * (found ** 2).sum(axis=1)).argmax(axis=1)


class Lists:
    """Two levels of centroids; a list is a centroid of the second."""

    def __init__(self, sample: np.ndarray, count: int, seed: int = 5):
        random = np.random.Generator(np.random.PCG64(seed))
        self.first = centres(sample, max(round(count ** 0.5), 1), random)
        own = nearest_centre(sample, self.first)
        parts = []
        for cell in range(len(self.first)):
            inside = sample[own == cell]
            share = max(round(count * len(inside) / len(sample)), 1)
            parts.append(centres(inside, share, random) if len(inside) else self.first[cell:cell + 1])
        self.second = np.concatenate(parts)
        self.ends = np.cumsum([len(part) for part in parts])

    def of(self, points: np.ndarray) -> np.ndarray:
        """The list of every vector: nearest cell, then the nearest centroid inside it."""
        cells = nearest_centre(points, self.first)
        result = np.zeros(len(points), np.int64)
        for cell in np.unique(cells):
            low = self.ends[cell - 1] if cell else 0
            result[cells == cell] = low + nearest_centre(points[cells == cell], self.second[low:self.ends[cell]])
        return result

    def visits(self, points: np.ndarray, sizes: np.ndarray, probe: int, least: int) -> list[np.ndarray]:
        """Per query the nearest lists, as many as ``probe`` and as hold ``least`` vectors."""
        gaps = 0.5 * (self.second ** 2).sum(axis=1) - points @ self.second.T
        order = np.argsort(gaps, axis=1, kind="stable")
        short = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1)
        return [row[:max(probe, enough + 1)] for row, enough in zip(order, short)]


def built(vectors: DataFrame, lists: int | None = None) -> tuple[DataFrame, Lists, np.ndarray]:
    """``rep, vector`` with their list, the centroids, and every list's size."""
    total = vectors.count()
    if not total:
        raise ValueError("no vectors")
    sample = vectors.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").toPandas()
    index = Lists(matrix(sample["vector"]), lists or max(round(total ** 0.5), 1))

    def deal(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(list=index.of(matrix(batch["vector"])))

    kind = vectors.schema["vector"].dataType.simpleString()
    dealt = stored(vectors.select("rep", "vector").mapInPandas(deal, f"rep bigint, vector {kind}, list bigint"), "lists")
    sizes = np.zeros(len(index.second), np.int64)
    for row in dealt.groupBy("list").count().collect():
        sizes[row["list"]] = row["count"]
    return dealt, index, sizes


def nearest_in_lists(vectors: DataFrame, key: str, vector: str, k: int = 5, probe: int = 8, queries: DataFrame | None = None,
                     lists: int | None = None) -> DataFrame:
    """About the ``k`` nearest other rows by inner product of unit vectors: ``id, rank, neighbour, score``.

    ``queries`` (a column like ``key``) asks for some rows only; every row asked for gets ``k`` rows, or all there are.
    """
    unique, tagged = distinct_vectors(vectors.select(key, vector), key, vector)
    unique, tagged = stored(unique, "distinct-vectors"), stored(tagged, "copies")
    dealt, index, sizes = built(unique, lists)
    if queries is not None:
        tagged_queries = tagged.join(queries.select(F.col(queries.columns[0]).alias("id")).distinct(), "id", "left_semi")
        asked = unique.join(tagged_queries.select("rep").distinct(), "rep", "left_semi")
    else:
        tagged_queries, asked = tagged, unique

    def visit(batches):
        for batch in batches:
            for low in range(0, len(batch), CHUNK):
                part = batch.iloc[low:low + CHUNK]
                visited = index.visits(matrix(part["vector"]), sizes, probe, k + 1)
                at = np.repeat(np.arange(len(part)), [len(row) for row in visited])
                yield part.iloc[at].assign(list=np.concatenate(visited))[["rep", "vector", "list"]]

    kind = unique.schema["vector"].dataType.simpleString()
    visits = stored(asked.select("rep", "vector").mapInPandas(visit, f"rep bigint, vector {kind}, list bigint"), "visits")
    # A row per list: into how many tiles its members and its queries are cut.
    tiles = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")) \
        .join(visits.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("asking")), "list")
    mine = lambda count: F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    members = dealt.join(tiles, "list").select("list", mine("tiles").alias("tile"), every("asking").alias("asker"), "rep", "vector")
    askers = visits.join(tiles, "list").select("list", every("tiles").alias("tile"), mine("asking").alias("asker"), "rep", "vector")

    def kernel(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"id": [], "neighbour": [], "score": []})]
        if len(others):
            base, ids = matrix(others["vector"]), others["rep"].to_numpy()
            take = min(k + 1, len(ids))
            for low in range(0, len(own), CHUNK):
                part = own.iloc[low:low + CHUNK]
                score = matrix(part["vector"]) @ base.T
                at, column = np.nonzero(score >= np.partition(score, -take, axis=1)[:, -take][:, None])
                found.append(pd.DataFrame({
                    "id": part["rep"].to_numpy()[at], "neighbour": ids[column], "score": score[at, column],
                }).sort_values(["id", "score", "neighbour"], ascending=[True, False, True]).groupby("id").head(k + 1))
        return pd.concat(found)

    where = ["list", "tile", "asker"]
    partial = askers.groupBy(*where).cogroup(members.groupBy(*where)).applyInPandas(kernel, "id bigint, neighbour bigint, score double")
    close = top_per_group(partial, ["id"], [F.desc("score"), F.asc("neighbour")], k + 1).drop("rank")
    return with_copies(close, tagged, k, tagged_queries)
