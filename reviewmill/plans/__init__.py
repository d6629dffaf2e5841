"""Registered queries: each runs one operator over the given tables."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import (  # noqa: F401
    dashboard, exploration, grouping, incremental, intake, learning, preparation, raw_store, sentiment, topics, vectors,
)
