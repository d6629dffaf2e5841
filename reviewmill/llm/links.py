"""Components of links, between tables and inside one tile of work."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components


def components_of(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of the undirected ``links(a, b)``: its smallest reachable end.

    Documents without links are not in the result, so the rounds run over the linked ones only.
    """
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return connected_components(nodes, links.where("a <> b"))


def local_roots(close: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest name reachable by a tile's links, for its rows named ``left`` and its columns named ``right``."""
    far = np.iinfo(np.int64).max
    rows, columns = left.astype(np.int64), right.astype(np.int64)
    while True:
        new_rows = np.minimum(rows, np.where(close, columns[None, :], far).min(axis=1, initial=far))
        new_columns = np.minimum(columns, np.where(close, new_rows[:, None], far).min(axis=0, initial=far))
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns
