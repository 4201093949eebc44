"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is f times its size takes each of its documents floor(f) times and once more with inclusion
probability f - floor(f). The extra copies are chosen by the cube method. In the flight phase the vector of inclusion
probabilities moves at random inside the null space of the balancing constraints (token total and document total): each
step finds a direction for three undecided documents that changes neither total, and goes to one face of the cube or the
other with the probabilities that leave every inclusion probability as it was on average. Blocks of about ``BLOCK``
documents of a source fly by themselves, the two or fewer that each leaves undecided meet in the next level, and so on
until one block is left of each source. There the long documents are settled first, each along the direction that moves
it most while all others make up for it, so the landing problem is that of two short ones: of the samples with their
inclusion probabilities it draws from those that keep nearest to the totals.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import discard, materialize

WEIGHTS, CAP = (1, 2, 3), 3
BLOCK = 2048
EPS = 1e-9
FEW_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def sizes(text: str = "text"):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, null 0: the places where a word begins."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame) -> DataFrame:
    """(source, source_size) -> with weight and target.

    Targets share the total by weight; none exceeds CAP times its source's size, the excess being reshared by weight.
    With sources sorted by cap / weight the first few are capped and the others get weight * rate, so one running sum
    finds the rate. The windows run over one row a source.
    """
    w = per_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), F.expr(f"cast(rank % {len(WEIGHTS)} as int) + 1")))
    w = w.withColumn("cap", F.col("source_size") * float(CAP)).withColumn("level", F.col("cap") / F.col("weight"))
    order = Window.orderBy("level", "rank")
    whole = Window.partitionBy(F.lit(1))
    w = w.withColumn("cap_before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    w = w.withColumn("weight_from", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("rate", (F.sum("source_size").over(whole) - F.coalesce("cap_before", F.lit(0.0))) / F.col("weight_from"))
    # the first source whose cap lies above its share at that point starts the uncapped ones
    w = w.withColumn("free", F.min(F.when(F.col("level") > F.col("rate"), F.struct("level", "rank", "rate"))).over(whole))
    capped = F.col("free").isNull() | (F.struct("level", "rank") < F.struct("free.level", "free.rank"))
    return w.select("source", "source_size", "weight", F.when(capped, F.col("cap")).otherwise(F.col("weight") * F.col("free.rate")).alias("target"))


def direction(sizes: Sequence[float]) -> list[float]:
    """Of three documents, the move that changes neither their number nor their tokens."""
    a, b, c = sizes
    u = [b - c, c - a, a - b]
    top = max(map(abs, u))
    return [x / top for x in u] if top else [1.0, -1.0, 0.0]


def flight(p: Sequence[float], size: Sequence[float], draw: random.Random) -> list[float]:
    """Flight phase: 0 and 1 for all but two documents at most, whose p stays within; both totals stay as they were."""
    p = list(p)
    waiting = iter([i for i, x in enumerate(p) if EPS < x < 1 - EPS])
    hand = list(islice(waiting, 3))
    while len(hand) == 3:
        u = direction([size[i] for i in hand])
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(hand, u) if x)
        down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(hand, u) if x)
        # the mean move is nil: up with probability down / (up + down)
        step = up if draw.random() * (up + down) < down else -down
        for i, x in zip(hand, u):
            p[i] += step * x
        done = [i for i in hand if not EPS < p[i] < 1 - EPS]
        for i in done:
            p[i] = float(p[i] > 0.5)
            hand.remove(i)
            more = next(waiting, None)
            if more is not None:
                hand.append(more)
    return p


def last_flight(p: Sequence[float], size: Sequence[float], draw: random.Random) -> list[float]:
    """Flight over a whole block at a time that settles the long documents first; the two left are short ones."""
    p, size = np.array(p, float), np.array(size, float)
    order = np.argsort(-size, kind="stable")
    while True:
        left = order[(p[order] > EPS) & (p[order] < 1 - EPS)]
        if len(left) <= 2:
            return p.tolist()
        # the part of each unit vector that both totals leave free
        x = np.column_stack([np.ones(len(left)), (size[left] - size[left].mean()) / max(size[left].std(), 1.0)])
        back = np.linalg.pinv(x)
        free = 1 - (x * back.T).sum(axis=1)
        a = int(np.argmax(free > 1e-6))
        u = -x @ back[:, a]
        u[a] += 1
        u[np.abs(u) < 1e-12] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - p[left]) / u, np.where(u < 0, -p[left] / u, np.inf)).min()
            down = np.where(u > 0, p[left] / u, np.where(u < 0, (p[left] - 1) / u, np.inf)).min()
        p[left] = np.clip(p[left] + (up if draw.random() * (up + down) < down else -down) * u, 0, 1)
        p = np.where(p <= EPS, 0.0, np.where(p >= 1 - EPS, 1.0, p))


def land(p: Sequence[float], size: Sequence[float], draw: random.Random) -> list[float]:
    """Landing phase: settles the last documents (two at most) with the inclusion probabilities that they have."""
    p = list(p)
    left = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    if len(left) == 1:
        p[left[0]] = float(draw.random() < p[left[0]])
    if len(left) == 2:
        i, j = left
        # of the joint laws with these marginals the cost is least where both are taken together as seldom as can be
        both, either = max(0.0, p[i] + p[j] - 1), min(1.0, p[i] + p[j])
        r = draw.random()
        if r < both:
            p[i], p[j] = 1.0, 1.0
        elif r < p[i]:
            p[i], p[j] = 1.0, 0.0
        elif r < either:
            p[i], p[j] = 0.0, 1.0
        else:
            p[i], p[j] = 0.0, 0.0
    return [float(x > 0.5) for x in p]


STATE = "source string, doc_id long, size long, mix long, p double, source_size long, target double, whole long, n_rows long"
COLUMNS = [x.split()[0] for x in STATE.split(", ")]


def _level(last: bool, seed: int):
    """One block: flight in random order; on the last level that of the whole block, and landing."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mix", "size", "doc_id"], kind="stable")
        draw = random.Random(f"{seed} {key} {rows['n_rows'].iloc[0]}")
        p, size = rows["p"].tolist(), rows["size"].tolist()
        got = land(last_flight(p, size, draw), size, draw) if last else flight(p, size, draw)
        return rows.assign(p=got)[COLUMNS]

    return run


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) of every document.

    Weights 1, 2, 3 repeat over the sources by code point, null last. Documents without words take nothing; sources
    without words have target 0. Every row counts and is drawn by itself, so rows that repeat a doc_id may take
    different numbers; null ids are drawn like others. Only ids, sources and sizes are shuffled, blocks are dealt by a
    hash of doc_id, size and seed, and reruns agree whatever the partitions. Further columns are ignored; an empty table
    gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), sizes().alias("size"))
    base = materialize(base.withColumn("mix", F.xxhash64("doc_id", "size", F.lit(seed))), "sizes")
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_rows"))
    per = materialize(per, "sources", n=F.count(F.lit(1)))
    goal = targets(per.select("source", "source_size")).join(per.select(F.col("source").alias("s"), "n_rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goal = materialize(goal, "targets")
    # tables of one row a source are broadcast if there are at most FEW_SOURCES
    hint = F.broadcast if per.measured["n"] <= FEW_SOURCES else (lambda t: t)
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    full = F.least(F.floor(f + EPS), F.lit(CAP))
    g = goal.select(F.col("source").alias("s"), "source_size", "target", "n_rows")
    rows = base.join(hint(g), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumns({"whole": full.cast("long"), "p": F.greatest(F.lit(0.0), F.least(F.lit(1.0), f - full))}).select(*COLUMNS)
    open_ = F.expr(f"size > 0 and p > {EPS} and p < 1 - {EPS}")
    parts, todo, level = [rows.where(~open_)], rows.where(open_), 0
    while True:
        # n_rows: an upper bound of the rows that a source still has
        one = todo.where(f"n_rows <= {BLOCK}")
        many = todo.where(f"n_rows > {BLOCK}").withColumn("block", F.expr(f"pmod(xxhash64(mix, n_rows), cast(ceil(n_rows / {BLOCK}) as long))"))
        parts.append(materialize(one.groupBy("source").applyInPandas(_level(True, seed), STATE), "landed"))
        some = materialize(many.groupBy("source", "block").applyInPandas(_level(False, seed), STATE), "level", n=F.count(F.lit(1)))
        if not some.measured["n"]:
            break
        parts.append(some.where(~open_))
        left = some.where(open_)
        now = left.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("still"))
        todo = left.join(hint(now), F.col("source").eqNullSafe(F.col("s"))).withColumn("n_rows", F.col("still")).select(*COLUMNS)
        todo = materialize(todo, "todo")
    discard(per)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    taken = F.col("size") * (F.col("whole") + F.when(F.col("size") > 0, F.round("p")).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def take_mixture(docs: DataFrame) -> DataFrame:
    """The documents that the mixture takes, each once with ``copies`` (1 to 3) and ``taken`` words.

    Of rows that repeat a doc_id (or have none) with equal source and number of words, as many are taken as were drawn.
    Columns ``copies`` and ``taken`` are replaced.
    """
    keys = ["loomsift_id", "loomsift_size", "loomsift_source"]
    copies = F.when(F.col("taken") > 0, F.expr("cast(taken / size as int)"))
    drawn = mix(docs).select(F.col("doc_id").alias(keys[0]), F.col("size").alias(keys[1]), F.col("source").alias(keys[2]), copies.alias("c"))
    drawn = drawn.groupBy(*keys).agg(F.sort_array(F.collect_list("c"), asc=False).alias("loomsift_copies"), F.count(F.lit(1)).alias("rows"))
    drawn = materialize(drawn, "drawn", most=F.max("rows"))
    names = [c for c in docs.columns if c not in ("copies", "taken")]
    own = docs.select(*names).withColumns({keys[0]: F.col("doc_id").cast("long"), keys[1]: sizes(), keys[2]: F.col("source").cast("string")})
    got = drawn.where("size(loomsift_copies) > 0").drop("rows").withColumnsRenamed({k: f"{k}_m" for k in keys})
    out = own.join(got.hint("merge"), [own[k].eqNullSafe(got[f"{k}_m"]) for k in keys])
    out = out.withColumn("loomsift_k", F.lit(1))
    if (drawn.measured["most"] or 0) > 1:  # only then are there rows to tell apart
        out = out.withColumn("loomsift_k", F.row_number().over(Window.partitionBy(*keys).orderBy(keys[0])))
    out = out.withColumn("copies", F.get("loomsift_copies", F.col("loomsift_k") - 1)).where("copies > 0")
    return out.select(*names, "copies", (F.col("copies") * F.col(keys[1])).alias("taken"))
