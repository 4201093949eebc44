"""Exact deduplication by a distributed content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort places equal texts next to each other
in a partition, and one streaming pass compares each text in full with its predecessor. The range key is (32-byte
prefix, digest, doc_id): its sampled values are short whatever the texts' lengths, a popular opening is split by the
digest and a large group of copies by doc_id. Runs that touch a partition's border may go on in the next one; their
texts (two a partition at most) are compared in full with each other afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import materialize, bounded_batches, width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "part int, run long, doc_id long, text_sha256 string, keep_id long, group_size long, edge boolean, edge_text string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (digest, text, doc_id) -> each row with its run's greatest doc_id and size."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    ids: list[int] = []
    text = digest = None
    run = 0

    def flush(last: bool) -> pa.RecordBatch:
        n = len(ids)
        edge = run == 0 or last
        cols = [pa.array([part] * n, pa.int32()), pa.array([run] * n, pa.int64()), pa.array(ids, pa.int64()), pa.array([digest] * n, pa.string())]
        cols += [pa.array([max((i for i in ids if i is not None), default=None)] * n, pa.int64()), pa.array([n] * n, pa.int64()), pa.array([edge] * n, pa.bool_()), pa.array([text if edge else None] + [None] * (n - 1), pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["part", "run", "doc_id", "text_sha256", "keep_id", "group_size", "edge", "edge_text"])

    ready: list[pa.RecordBatch] = []
    for batch in batches:
        for d, t, i in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if ids and t != text:
                ready.append(flush(False))
                run += 1
                ids = []
            text, digest = t, d
            ids.append(i)
        if ready:
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
            ready = []
    if ids:
        yield flush(True)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document.

    Texts are equal if identical after lower-casing A-Z; null counts as empty, and nothing else is normalised. The
    greatest doc_id of a group stays. Rows that repeat a doc_id are counted one by one and share their ``kept``. A row
    of null doc_id counts in its group but stays only if the whole group has none (``keep_id`` is then null). Further
    columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER).alias("text"))
    norm = norm.withColumns({"text_sha256": F.sha2("text", 256), "head": F.substring(F.col("text").cast("binary"), 1, 32)})
    placed = norm.repartitionByRange(width(spark), "head", "text_sha256", "doc_id").sortWithinPartitions("head", "text_sha256", "text", "doc_id")
    runs = materialize(placed.select("text_sha256", "text", "doc_id").mapInArrow(_runs, RUNS), "runs")
    # runs at partition borders: two a partition at most, so their table is bounded by the number of partitions
    border = runs.where("edge_text is not null").groupBy("text_sha256", "edge_text").agg(F.max("keep_id").alias("k"), F.sum("group_size").alias("g"))
    border = border.select(F.col("text_sha256").alias("s"), "k", "g").where("g > 0")
    out = runs.join(F.broadcast(border), (F.col("text_sha256") == F.col("s")) & F.col("edge"), "left")
    out = out.select("doc_id", F.coalesce("k", "keep_id").alias("keep_id"), F.coalesce("g", "group_size").alias("group_size"), "text_sha256")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, and those of null doc_id, which no result can name."""
    kept = materialize(exact_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("loomsift_id")).distinct(), "kept")
    named = docs.where("doc_id is not null").join(kept.hint("merge"), F.col("doc_id").cast("long") == F.col("loomsift_id"), "left_semi")
    return named.unionByName(docs.where("doc_id is null"))


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
