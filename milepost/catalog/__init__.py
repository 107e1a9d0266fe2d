"""Registered queries by area."""

from milepost.catalog import (  # noqa: F401
    batch_queries,
    feature_queries,
    function_queries,
    learning_queries,
    snapshot_queries,
    stream_queries,
)
from milepost.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
