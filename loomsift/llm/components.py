"""Connected components over an edge table: hook each vertex to its least neighbour, jump to the roots, contract.

Up to ``ONE_TASK`` edges that is done in one task's memory, beyond that by rounds of joins; both give the same table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import discard, materialize

#: Distinct edges that one task takes: 16 MB of them. A round of joins costs the driver several jobs and their plans.
ONE_TASK = 1 << 20


def label(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of edges -> (vertices, least vertex that each reaches)."""
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(v))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return v, v[root]


def _label_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for batch in batches:
        for i in range(2):
            ends[i].append(batch.column(i).to_numpy(zero_copy_only=False))
    v, least = label(*(np.concatenate(x) for x in ends))
    for i in range(0, len(v), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)], pa.int64()) for x in (v, least)], ["v", "component"])


def _roots(parent: DataFrame) -> DataFrame:
    """(v, p) with p < v -> (v, p) with p the end of v's chain; each job halves the chains' lengths."""
    while True:
        up = parent.select(F.col("v").alias("w"), F.col("p").alias("q")).hint("merge")
        new = parent.join(up, F.col("p") == F.col("w"), "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved"))
        new = materialize(new, "jump", n=F.count_if("moved"))
        discard(parent)
        parent = new
        if not parent.measured["n"]:
            return parent


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected edges -> (v, component): each vertex with the least vertex it reaches, in the shared folder.

    Nulls and loops are ignored. Of the vertices that still have edges half at most stay roots in each round, so there
    are at most log2 of their number. Both sides of each join are tables, so that adaptive execution can split a vertex
    of many edges; nothing is collected but counts.
    """
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    cur = materialize(edges.where("a is not null and b is not null and a <> b").select(*pair).distinct(), "edges", n=F.count(F.lit(1)))
    if cur.measured["n"] <= ONE_TASK:
        out = materialize(cur.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(_label_rows, "v long, component long"), "comp")
        discard(cur)
        return out
    comp = cur.select(F.col("b").alias("v"), F.col("a").alias("component")).limit(0)
    spent = []
    while cur.measured["n"]:
        root = _roots(materialize(cur.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")), "parent"))
        r = root.select("v", "p").hint("merge")
        of_a, of_b = r.withColumnsRenamed({"v": "a", "p": "pa"}), r.withColumnsRenamed({"v": "b", "p": "pb"})
        left = cur.join(of_b, "b").join(of_a, "a", "left").select(F.col("pb").alias("b"), F.coalesce("pa", "a").alias("a")).where("a <> b")
        new = materialize(left.select(*pair).distinct(), "edges", n=F.count(F.lit(1)))
        was = comp.join(r.withColumnsRenamed({"v": "component", "p": "c"}), "component", "left").select("v", F.coalesce("c", "component").alias("component"))
        comp = materialize(was.unionByName(r.select("v", F.col("p").alias("component"))), "comp")
        spent.append(comp)
        discard(cur, root)
        cur = new
    out = materialize(comp.unionByName(comp.select(F.col("component").alias("v"), "component").distinct()), "comp")
    discard(cur, *spent)
    return out
