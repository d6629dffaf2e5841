"""Kernels that pass on a bounded number of rows at once."""

import numpy as np
import pandas as pd

from reviewmill.llm import multi_index


def test_visits_are_listed_for_few_vectors_at_once():
    random = np.random.default_rng(3)
    vectors = random.normal(size=(1500, 8))
    points = multi_index.unit(vectors)
    # A wide radius, so that every vector visits many cells.
    index = {8: multi_index.MultiIndex([multi_index.codebook(points[:, :4], 6, 1), multi_index.codebook(points[:, 4:], 6, 2)], cosine=0.0, reach=1.0)}
    batch = pd.DataFrame({"name": range(1500), "weight": 1, "vector": list(vectors), "label": "a", "size": 8})
    parts = list(multi_index.visits(iter([batch]), index))
    expected = [(name, cell) for name, (home, others) in enumerate(index[8].cells(points)) for cell in (home, *others)]
    assert [(row.name_, row.cell) for part in parts for row in part.rename(columns={"name": "name_"}).itertuples()] == expected
    assert max(part["name"].nunique() for part in parts) <= multi_index.VISITORS_AT_ONCE < 1500
