"""Near copies among vectors with an inverted multi-index.

Vectors are scaled to length 1 and cut into halves.  Each half has a codebook, fit
by k-means on a bounded sample; a pair of nearest codes is a cell of the product
grid, and every vector is stored in its cell.  A vector also visits the cells
that may hold a near copy of it, in the order of their distance: the two halves'
lists of codes, each ordered by the distance to the border of the code's region,
are merged by a multi-sequence traversal, which stops at the radius that reaches
the target recall.  Inside a cell pairs are verified in double precision.

The radius: vectors with cosine ``c`` differ by ``r = sqrt(2 - 2 c)``.  With
``reach = 1`` all cells whose region comes within ``r`` are visited and nothing is
missed.  A smaller reach visits cells within ``reach * r``; a difference spread
over ``d`` dimensions leans only about ``r / sqrt(d)`` towards a border, so
``REACH`` misses next to none.  Of a pair each vector looks for the other, so a link
is lost only if neither's cells reach the other's; a pair that meets both ways is
counted in the higher of its two cells.

Equal vectors are one vector with a weight.  Cells with more than ``TILE`` vectors
are cut into tiles that meet in pairs, so a hot cell is many tasks.  A task
returns counts and one link per vector, never its pairs.

Edge cases: null vectors, zero vectors and vectors with null or non-finite
components, and rows with a null label, link with nothing and are their own
components; vectors of other dimensions only meet their like; equal ``vec_id``
count as different vectors that share a component; a null ``vec_id`` has a null
component and links nothing; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .links import components_of, local_roots

COSINE = 0.98
SAMPLE = 20_000
REACH = 0.6
CELL_ROWS = 256
MOST_CODES = 512
ROUNDS = 8
TILE = 1024
#: Vectors whose visits are listed at once; one may visit hundreds of cells.
VISITORS_AT_ONCE = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def codebook(points: np.ndarray, codes: int, seed: int) -> np.ndarray:
    """K-means centres of one half."""
    random = np.random.Generator(np.random.PCG64(seed))
    distinct = np.unique(points, axis=0)
    centres = distinct[random.choice(len(distinct), min(codes, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (points @ centres.T - 0.5 * (centres ** 2).sum(axis=1)).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


class MultiIndex:
    """Two codebooks and the traversal of their product."""

    def __init__(self, halves: list[np.ndarray], cosine: float = COSINE, reach: float = REACH):
        self.halves, self.radius = halves, reach * float(np.sqrt(max(2 - 2 * cosine, 0.0)))
        self.gaps = [np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2)) for c in halves]

    def borders(self, half: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest code, and squared distance to the border of every code's region (0 at the own)."""
        centres = self.halves[half]
        far = ((points ** 2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres ** 2).sum(axis=1)).clip(0)
        own = far.argmin(axis=1)
        gap = self.gaps[half][own]
        rows = np.arange(len(points))
        with np.errstate(divide="ignore", invalid="ignore"):
            border = np.where(gap > 0, (far - far[rows, own][:, None]) / (2 * gap), 0.0)
        return own, border ** 2

    def cells(self, vectors: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """For every vector its cell and the other cells to visit, nearest first."""
        middle = self.halves[0].shape[1]
        width = len(self.halves[1])
        (own_a, far_a), (own_b, far_b) = self.borders(0, vectors[:, :middle]), self.borders(1, vectors[:, middle:])
        limit = self.radius ** 2
        for row in range(len(vectors)):
            near_a, near_b = np.flatnonzero(far_a[row] <= limit), np.flatnonzero(far_b[row] <= limit)
            list_a = sorted(zip(far_a[row][near_a].tolist(), near_a.tolist()))
            list_b = sorted(zip(far_b[row][near_b].tolist(), near_b.tolist()))
            home = int(own_a[row]) * width + int(own_b[row])
            yield home, [cell for cell in self.traverse(list_a, list_b, limit, width) if cell != home]

    @staticmethod
    def traverse(first: list, second: list, limit: float, width: int) -> Iterator[int]:
        """Multi-sequence: cells by the sum of both distances, up to ``limit``."""
        heap, seen = [(first[0][0] + second[0][0], 0, 0)], {(0, 0)}
        while heap:
            far, a, b = heapq.heappop(heap)
            if far > limit:
                return
            yield first[a][1] * width + second[b][1]
            for step in ((a + 1, b), (a, b + 1)):
                if step[0] < len(first) and step[1] < len(second) and step not in seen:
                    seen.add(step)
                    heapq.heappush(heap, (first[step[0]][0] + second[step[1]][0], *step))


def usable(vector: Column) -> Column:
    """A vector without null or non-finite components that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def fit_index(vectors: DataFrame, cosine: float = COSINE, reach: float = REACH, sample: int = SAMPLE, cell_rows: int = CELL_ROWS,
              ) -> dict[int, MultiIndex]:
    """An index for every dimension; the first ``sample`` vectors by hash fit it, all rows set its number of codes."""
    sizes = {row["size"]: row["count"] for row in vectors.groupBy("size").count().collect()}
    chosen = vectors.orderBy(F.xxhash64(F.lit(3), "rep"), "rep").limit(sample).select("size", "vector").toPandas()
    result = {}
    for size, count in sizes.items():
        rows = chosen.loc[chosen["size"] == size, "vector"]
        points = unit(np.stack(list(rows))) if len(rows) else np.eye(1, size)
        codes = int(np.clip(np.ceil(np.sqrt(count / cell_rows)), 2, MOST_CODES))
        middle = max(size // 2, 1)
        halves = [points[:, :middle], points[:, middle:] if size > 1 else np.zeros((len(points), 1))]
        result[size] = MultiIndex([codebook(half, codes, 11 + at) for at, half in enumerate(halves)], cosine, reach)
    return result


def _spread(vectors: np.ndarray) -> np.ndarray:
    return vectors if vectors.shape[1] > 1 else np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1)


def tile_links(home: pd.DataFrame, guest: pd.DataFrame | None, cosine: float, cell: int | None = None) -> pd.DataFrame:
    """Links of one tile: per vector the weight of what it links with, and the first of what it reaches in the tile.

    ``guest`` is None inside one tile; else every home vector meets every guest.  Guests of ``cell`` that come from a
    higher one have met the home vectors that went there.
    """
    other = home if guest is None else guest
    left, right = unit(np.stack(list(home["vector"]))), unit(np.stack(list(other["vector"])))
    close = left @ right.T >= cosine
    if guest is None:
        np.fill_diagonal(close, False)
    elif cell is not None:
        origin = guest["origin"].to_numpy()
        for row, column in zip(*np.nonzero(close & (origin > cell)[None, :])):
            close[row, column] = origin[column] not in home["higher"].iloc[row]
    names, names_other = home["rep"].to_numpy(), other["rep"].to_numpy()
    roots, roots_other = local_roots(close, names, names_other)
    if guest is None:
        roots = np.minimum(roots, roots_other)
    linked = close.any(axis=1)
    rows = [pd.DataFrame({"rep": names, "links": close @ other["weight"].to_numpy(), "least": roots})[linked]]
    if guest is not None:
        linked = close.any(axis=0)
        rows.append(pd.DataFrame({"rep": names_other, "links": home["weight"].to_numpy() @ close, "least": roots_other})[linked])
    return pd.concat(rows)


def visits(batches: Iterator[pd.DataFrame], index: dict[int, MultiIndex]) -> Iterator[pd.DataFrame]:
    """Every vector once for its own cell and for each that it visits, a bounded number of vectors at a time."""
    for batch in batches:
        for size, rows in batch.groupby("size"):
            for low in range(0, len(rows), VISITORS_AT_ONCE):
                part = rows.iloc[low:low + VISITORS_AT_ONCE]
                points = _spread(unit(np.stack(list(part["vector"]))))
                at, cells, homes, origins, higher = [], [], [], [], []
                for row, (home, others) in enumerate(index[size].cells(points)):
                    at += [row] * (1 + len(others))
                    cells += [home, *others]
                    homes += [True] + [False] * len(others)
                    origins += [home] * (1 + len(others))
                    # What meets here and there is told apart by where the home vectors went.
                    higher += [[cell for cell in others if cell > home]] + [None] * len(others)
                out = part.iloc[at].copy()
                out["cell"], out["home"], out["origin"] = np.array(cells, np.int64), homes, np.array(origins, np.int64)
                out["higher"] = higher
                yield out[["name", "weight", "vector", "label", "size", "cell", "home", "origin", "higher"]]


def linked(vectors: DataFrame, cosine: float = COSINE, reach: float = REACH, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for ``vectors(vec_id, embedding, label)``; links need equal labels."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))
    good = rows.where(usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()) \
        .withColumn("key", F.sha2(F.concat_ws("/", "label", F.col("vector").cast("string")), 256))
    classes = good.groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"),
        F.first("label").alias("label"), F.first(F.size("vector")).alias("size"))
    # Equal ids can have different vectors: the class number keeps them apart, the id carries the component.
    classes = stored(classes.withColumn("name", F.monotonically_increasing_id()), "vector-classes")
    index = fit_index(classes, cosine, reach, cell_rows=cell_rows)

    placed = stored(classes.select("name", "weight", "vector", "label", "size").mapInPandas(
        lambda batches: visits(batches, index), "name bigint, weight bigint, vector array<double>, label string, size int, cell bigint, home boolean, "
        "origin bigint, higher array<bigint>"), "cells")
    where = ["label", "size", "cell"]
    loads = placed.groupBy(*where).agg(
        F.sum(F.col("home").cast("int")).alias("homes"), F.sum((~F.col("home")).cast("int")).alias("guests")) \
        .where("homes > 0").withColumns({
            "home_tiles": F.ceil(F.col("homes") / TILE).cast("int"), "guest_tiles": F.ceil(F.col("guests") / TILE).cast("int")})
    sized = placed.join(loads.select(*where, "home_tiles", "guest_tiles"), where)
    mine = F.pmod(F.xxhash64("name"), F.when(F.col("home"), F.col("home_tiles")).otherwise(F.greatest("guest_tiles", F.lit(1)))).cast("int")
    tiles = sized.withColumn("mine", mine).withColumn("meets", F.when(F.col("home"), F.concat(
        # Home tiles meet each other once and every guest tile.
        F.transform(F.sequence(F.lit(0), F.col("home_tiles") - 1), lambda t: F.struct(
            F.lit("h").alias("kind"), F.least(t, F.col("mine")).alias("low"), F.greatest(t, F.col("mine")).alias("high"))),
        F.when(F.col("guest_tiles") > 0, F.transform(F.sequence(F.lit(0), F.greatest("guest_tiles", F.lit(1)) - 1), lambda t: F.struct(
            F.lit("g").alias("kind"), F.col("mine").alias("low"), t.alias("high")))).otherwise(
            F.array().cast("array<struct<kind:string,low:int,high:int>>"))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.col("home_tiles") - 1), lambda t: F.struct(
            F.lit("g").alias("kind"), t.alias("low"), F.col("mine").alias("high"))))) \
        .select(*where, "name", "weight", "vector", "home", "mine", "origin", "higher", F.explode("meets").alias("tile")) \
        .select(*where, "tile.*", F.col("name").alias("rep"), "weight", "vector", "home", "mine", "origin", "higher")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        if group["kind"].iloc[0] == "g":
            first, second = group[group["home"]], group[~group["home"]]
        elif group["low"].iloc[0] == group["high"].iloc[0]:
            first, second = group, None
        else:
            first, second = group[group["mine"] == group["low"]], group[group["mine"] == group["high"]]
        if not len(first) or (second is not None and not len(second)):
            return pd.DataFrame({"rep": [], "links": [], "least": []}).astype("int64")
        return tile_links(first, second, cosine, int(group["cell"].iloc[0]) if group["kind"].iloc[0] == "g" else None)

    # Groups of at most two tiles.
    found = stored(tiles.groupBy(*where, "kind", "low", "high").applyInPandas(
        meet, "rep bigint, links bigint, least bigint"), "vector-links")
    ids = classes.select("name", "rep", "weight")
    counts = found.groupBy(F.col("rep").alias("name")).agg(F.sum("links").alias("links"))
    named = found.select(F.col("rep").alias("name"), "least").distinct().join(ids.select("name", F.col("rep").alias("a")), "name") \
        .join(ids.select(F.col("name").alias("least"), F.col("rep").alias("b")), "least").select("a", "b")
    members = good.select("vec_id", "key").join(classes.select("key", "name", "rep", "weight"), "key") \
        .join(counts, "name", "left").select("vec_id", "rep", "weight", "links")
    copies = members.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")).distinct()
    parts = components_of(stored(named.where("a <> b").unionByName(copies), "edges"))
    stated = members.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    rest = rows.where(~(F.coalesce(usable(F.col("vector")), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())) \
        .select("vec_id", F.lit(0).cast("bigint").alias("n_links"))
    return stated.unionByName(rest).join(parts, F.col("vec_id") == F.col("node"), "left").select(
        "vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component", "vec_id")).alias("kept"))
