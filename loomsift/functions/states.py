"""Life of a file: states and their views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMPLE = {
    "Initializing": "working", "Supported": "working", "CheckingMetadata": "working", "RemovingMetadata": "working",
    "ErrorWhileInitializing": "error", "ErrorWhileCheckingMetadata": "error", "ErrorWhileRemovingMetadata": "error", "Unsupported": "error",
    "HasNoMetadata": "warning", "HasMetadata": "has-metadata", "Cleaned": "clean",
}
WORKING = tuple(k for k, v in SIMPLE.items() if v == "working")
CLEANABLE = ("HasMetadata", "HasNoMetadata")


def simple_state(state: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SIMPLE.items() for x in kv]), state)


def is_working(state: Column) -> Column:
    return state.isin(*WORKING)


def is_cleanable(state: Column) -> Column:
    return state.isin(*CLEANABLE)


def is_empty(groups: Column) -> Column:
    """No group has an item."""
    return ~F.exists(groups, lambda g: F.size(g["items"]) > 0)


def total_count(groups: Column) -> Column:
    return F.coalesce(F.aggregate(groups, F.lit(0), lambda n, g: n + F.size(g["items"])), F.lit(0)).cast("long")
