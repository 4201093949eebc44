"""The table of files as a fold over their events, and its views.

Events: (seq, file_id, type, state, items, message). ``state`` events set the state; ``ready`` ones set HasMetadata or
HasNoMetadata by their number of items; ``error`` ones set state and error text. The last event of a file by ``seq``
wins without any check of transitions, and no later event takes an error text away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.states import is_cleanable, is_working, simple_state


def event_state() -> Column:
    ready = F.when(F.col("items") > 0, "HasMetadata").otherwise("HasNoMetadata")
    return F.when(F.col("type") == "ready", ready).otherwise(F.col("state"))


def fold_events(events: DataFrame) -> DataFrame:
    """(file_id, state, item_count, error): partial aggregation first, one small row a file is shuffled."""
    e = events.withColumn("new", event_state())
    ready, failed = F.col("type") == "ready", F.col("type") == "error"
    return e.groupBy("file_id").agg(
        F.max_by("new", "seq").alias("state"),
        F.max_by(F.when(ready, F.col("items")), F.when(ready, F.col("seq"))).cast("long").alias("item_count"),
        F.max_by(F.when(failed, F.col("message")), F.when(failed, F.col("seq"))).alias("error"),
    )


def apply_to(files: DataFrame, events: DataFrame) -> DataFrame:
    """files (file_id, state) after the events; events of ids that aren't there (any more) are dropped."""
    folded = fold_events(events.join(files.select("file_id"), "file_id", "left_semi")).withColumnsRenamed({"state": "new", "item_count": "new_items", "error": "new_error"})
    out = files.join(folded, "file_id", "left")
    cols = [c for c in files.columns if c not in ("state", "item_count", "error")]
    old = {c: F.col(c) if c in files.columns else F.lit(None) for c in ("item_count", "error")}
    return out.select(*cols, F.coalesce("new", "state").alias("state"), F.coalesce("new_items", old["item_count"]).alias("item_count"), F.coalesce("new_error", old["error"]).alias("error"))


def drop_stale(events: DataFrame, files: DataFrame) -> DataFrame:
    return events.join(files.select("file_id").distinct(), "file_id", "left_semi")


def summary(store: DataFrame) -> DataFrame:
    """One row: totals, progress (0 of nothing), status and whether cleaning may start."""
    s = store.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_cleanable(F.col("state"))).alias("cleanable_count"),
        F.count_if(F.col("state") == "Cleaned").alias("cleaned_count"),
        F.coalesce(F.bool_or(is_working(F.col("state"))), F.lit(False)).alias("has_working"),
        F.count_if(~is_working(F.col("state"))).alias("done"),
    )
    status = F.when(F.col("total") == 0, "idle").when(F.col("done") == F.col("total"), "done").otherwise("working")
    return s.select(
        "*",
        F.when(F.col("total") == 0, 0.0).otherwise(F.col("done") / F.col("total")).alias("progress"),
        status.alias("status"),
        ((F.col("cleanable_count") > 0) & ~F.col("has_working")).alias("clean_enabled"),
        F.format_string("%d file(s) cleaned.", "cleaned_count").alias("message"),
    )


def list_rows(store: DataFrame) -> DataFrame:
    """What a list view shows."""
    return store.select("filename", "directory", simple_state(F.col("state")).alias("simple_state"), F.coalesce("item_count", F.lit(0)).cast("long").alias("metadata_count"))


def details(items: DataFrame) -> DataFrame:
    """(file_id, header, lines): the first group's name and the items of all groups in order, of each file."""
    each = F.struct("group_ord", "item_ord", "group_name", "key", "value")
    grouped = items.groupBy("file_id").agg(F.sort_array(F.collect_list(each)).alias("m"))
    return grouped.select("file_id", F.col("m")[0]["group_name"].alias("header"), F.transform("m", lambda x: F.concat(x["key"], F.lit(": "), x["value"])).alias("lines"))


def to_clean(store: DataFrame) -> DataFrame:
    """Cleanable rows, now being cleaned."""
    return store.where(is_cleanable(F.col("state"))).withColumn("state", F.lit("RemovingMetadata"))


def remove(store: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Ids that aren't there do nothing."""
    return store.join(file_ids.select("file_id").distinct(), "file_id", "left_anti")


def clear(store: DataFrame) -> DataFrame:
    """No row, the same columns."""
    return store.limit(0)


def position(store: DataFrame, file_id: object) -> DataFrame:
    """(position) of a file among the rows in order of file_id, from 0; no row if it isn't there. One count, no sort."""
    before = store.agg(F.count_if(F.col("file_id") < F.lit(file_id)).alias("position"), F.coalesce(F.bool_or(F.col("file_id") == F.lit(file_id)), F.lit(False)).alias("there"))
    return before.where("there").select("position")
