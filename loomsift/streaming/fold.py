"""The event fold as a stream: last state of each file; arrival order does not matter, as ``seq`` decides."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import fold_events


def _folder(spark: SparkSession) -> str:
    """Below ``spark.checkpoint.dir``; in local mode (tests) a temporary folder where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named.rstrip('/') if named else 'file://' + tempfile.mkdtemp(prefix='loomsift-')}/loomsift/stream-{uuid.uuid4().hex}"


def fold_stream(events: DataFrame) -> DataFrame:
    """A streaming DataFrame of events -> the running store; write it in complete or update mode."""
    return fold_events(events)


def run_to_end(stream: DataFrame, mode: str = "complete", key: str = "file_id") -> DataFrame:
    """Process all that is there, in as many micro-batches as the source makes, and return the store as it is then.

    In complete mode that is the last batch; in update mode the last row of each ``key`` over all batches, as a batch
    holds only what changed in it. Without input the result is empty.
    """
    spark = stream.sparkSession
    base = _folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/rows/batch=-1")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{base}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("last"))  # one row
        return rows.join(F.broadcast(last), F.col("batch") == F.col("last")).select(*stream.columns)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("r"))
    return newest.select("r.*")


def fold_with_state(events: DataFrame) -> DataFrame:
    """The same fold with explicit state (update mode): one small tuple a file, no watermark, no row lost.

    Events are ordered by (seq, tie); ``tie`` is 0 where there is no such column.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, tie, name, error_seq, error_tie, error = state.get if state.exists else (None,) * 6
        for b in batches:
            b = b.sort_values(["seq", "tie"])
            r = b.iloc[-1]
            if seq is None or (int(r["seq"]), int(r["tie"])) > (seq, tie):
                seq, tie = int(r["seq"]), int(r["tie"])
                name = ("HasMetadata" if r["items"] > 0 else "HasNoMetadata") if r["type"] == "ready" else r["state"]
            bad = b[b["type"] == "error"]
            if len(bad):
                r = bad.iloc[-1]
                if error_seq is None or (int(r["seq"]), int(r["tie"])) > (error_seq, error_tie):
                    error_seq, error_tie, error = int(r["seq"]), int(r["tie"]), r["message"]
        state.update((seq, tie, name, error_seq, error_tie, error))
        yield pd.DataFrame([(key[0], name, error)], columns=["file_id", "state", "error"])

    tie = F.col("tie").cast("long") if "tie" in events.columns else F.lit(0).cast("long").alias("tie")
    return events.select("file_id", F.col("seq").cast("long").alias("seq"), tie, "type", "state", F.coalesce("items", F.lit(0)).alias("items"), "message").groupBy("file_id").applyInPandasWithState(
        step, "file_id long, state string, error string", "seq long, tie long, state string, error_seq long, error_tie long, error string", "update", GroupStateTimeout.NoTimeout
    )
