"""Near-duplicate detection with b-bit MinHash.

Signatures are 128 minima of each document's distinct word-shingle set. Bands of ``ROWS`` full minima propose
candidates; of each minimum only the low two bits are retained, packed into four longs, and candidates whose
collision-corrected similarity (bit counts of XORed signatures) lies far below the threshold are dropped before
the exact comparison of full sets. Exactly equal sets are collapsed first.

Buckets are not expanded into all pairs. Each document is first compared with the least leader of its buckets, then
with the leader of each bucket in which it is still apart; members that fall into a leader's component need no
further pair. Buckets that then still hold different components are joined into clusters. Those of ``BLOCK`` documents
or fewer are compared exactly inside one task (signature estimate, set sizes, full sets). The documents of larger ones
are banded anew by ``FINE_BANDS`` bands of ``FINE_ROWS`` fresh minima, which part what only shares frequent words, and go
through leaders once more; what is open then is compared exactly in blocks, by cluster or by bucket, whichever ships
fewer texts. Tasks emit verified links only: no link between different components is lost and no group is expanded
into pair rows.

Joins that can meet a frequent key have tables on both sides, so that adaptive execution can split it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import mix64, shingle_sets, string_buffer
from .session import discard, materialize, bounded_batches, width

HASHES, ROWS, BITS = 128, 4, 2
BANDS = HASHES // ROWS
#: Of the second banding: a pair at 0.8 is missed by all of them with probability 1e-9, one at 0.3 meets with 0.7 %.
FINE_ROWS, FINE_BANDS = 8, 112
#: Standard deviations of the estimate below the threshold at which a candidate is dropped unverified.
MARGIN = 6.0
#: Documents of a group that one task holds twice over in the exact rest.
BLOCK = 128
#: Members of a bucket that share one shipped copy of their leader's text.
CHUNK = 256


@lru_cache(1)
def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240711)
    a = r.integers(1, 2**63, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return a, r.integers(0, 2**63, HASHES, dtype=np.int64).astype(np.uint64)


def _minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each function a * h + b over a non-empty set; blocks fit in a cache and bound memory."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 15) // len(a))
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), step):
            x = a[:, None] * hashes[None, i : i + step]
            x += b[:, None]
            np.minimum(out, x.min(axis=1), out=out)
    return out


def signature(sets: np.ndarray) -> np.ndarray:
    """128 32-bit minima of a non-empty set of 64-bit hashes."""
    return (mix64(_minima(sets, *_coefficients())) >> np.uint64(32)).astype(np.uint64)


def _pack(minima: np.ndarray) -> np.ndarray:
    """Low two bits of each minimum, 32 to a long."""
    low = (minima & np.uint64(3)).reshape(-1, 4, 32)
    return (low << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _band_keys(minima: np.ndarray) -> np.ndarray:
    m = minima.reshape(-1, BANDS, ROWS)
    with np.errstate(over="ignore"):
        h = mix64(np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(1))[None, :]
        for r in range(ROWS):
            h = mix64(h * np.uint64(0x9FB21C651E98DF25) + m[:, :, r])
    return h.view(np.int64)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            sizes, keys, minima, has = [], [], [], []
            for i, s in enumerate(shingle_sets(*string_buffer(batch.column(1)), k)):
                sizes.append(len(s))
                if len(s):
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    minima.append(signature(s))
                    has.append(i)
            n = len(sizes)
            where = np.full(n, -1)
            where[has] = np.arange(len(has))
            m = np.array(minima, np.uint64).reshape(-1, HASHES)
            take = pa.array([int(x) if x >= 0 else None for x in where], pa.int64())
            packed, bands = _pack(m), _band_keys(m)
            cols = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()).take(take)]
            cols += [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel()).take(take) for x in (packed, bands)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "set_key", "sig", "bands"])

    return run


SIGNED = "doc_id long, n_shingles long, set_key binary, sig array<long>, bands array<long>"


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """One row a document: set size, digest of the set, packed signature, band keys (null for empty sets)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sign(k), SIGNED)


def _fine(k: int):
    """(id, text) -> (id, key): a row for each fine band."""
    r = np.random.default_rng(20240712)
    n = FINE_ROWS * FINE_BANDS
    a, b = r.integers(1, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in enumerate(shingle_sets(*string_buffer(batch.column(1)), k)):
                if not len(s):
                    continue
                m = mix64(_minima(s, a, b)).reshape(FINE_BANDS, FINE_ROWS)
                with np.errstate(over="ignore"):
                    h = mix64(np.arange(FINE_BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(7))
                    for j in range(FINE_ROWS):
                        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + m[:, j])
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * FINE_BANDS, pa.int64()), pa.array(h.view(np.int64))], ["id", "key"])

    return run


def _members(banded: DataFrame) -> DataFrame:
    """(id, key) of a table -> (key, id, n, lead) of the buckets that hold more than one document."""
    shared = materialize(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lead")).where("n > 1"), "buckets")
    out = materialize(banded.join(shared.hint("merge"), "key").select("key", "id", "n", "lead"), "members")
    discard(banded, shared)
    return out


def _estimate():
    """Collision-corrected similarity of columns ``sa`` and ``sb``."""
    differ = None
    for i in range(4):
        x = F.col("sa")[i].bitwiseXOR(F.col("sb")[i])
        d = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        differ = d if differ is None else differ + d
    c = 2.0**-BITS
    return (1 - differ / HASHES - c) / (1 - c)


def _floor(threshold: float) -> float:
    p = 2.0**-BITS + (1 - 2.0**-BITS) * threshold
    return threshold - MARGIN * (p * (1 - p) / HASHES) ** 0.5 / (1 - 2.0**-BITS)


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = np.zeros(0, np.uint64)
        for batch in batches:
            a, other, b = (batch.column(i).to_pylist() for i in (0, 2, 3))
            out_a, out_b = [], []
            for i, s in enumerate(shingle_sets(*string_buffer(batch.column(4)), k)):
                if not other[i]:
                    leader = s
                    continue
                small, big = (s, leader) if len(s) < len(leader) else (leader, s)
                if 100 * len(small) < percent * len(big) or not len(small):
                    continue
                at = np.searchsorted(big, small)
                both = int((big[np.minimum(at, len(big) - 1)] == small).sum())
                if 100 * both >= percent * (len(big) + len(small) - both):
                    out_a.append(a[i])
                    out_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Exact test of a table of pairs (a, b, chunk). A leader's text is shipped once for each of its chunks."""
    left = pairs.select("a", "chunk").distinct().join(texts, F.col("a") == F.col("doc_id")).select("a", "chunk", F.lit(0).alias("other"), F.col("a").alias("b"), "text")
    right = pairs.join(texts.hint("merge"), F.col("b") == F.col("doc_id")).select("a", "chunk", F.lit(1).alias("other"), "b", "text")
    both = left.unionByName(right).repartition(width(texts.sparkSession), "a", "chunk").sortWithinPartitions("a", "chunk", "other", "b")
    return materialize(both.mapInArrow(_verify(k, percent), "a long, b long"), "links")


def _compare(k: int, percent: int):
    """All pairs of two blocks of a cluster; rows come sorted by (group, i, j)."""
    floor = (_floor(percent / 100) * (1 - 2.0**-BITS) + 2.0**-BITS) * HASHES

    def pairs(rows: list) -> tuple[list, list]:
        ids, comps = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        block, sig, sets = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], np.int64).view(np.uint64), [r[4] for r in rows]
        sizes = np.array([len(x) for x in sets])
        same = block.min() == block.max()
        up = {c: c for c in set(comps.tolist())}

        def find(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        out_a, out_b = [], []
        for x in range(len(rows)):
            d = sig ^ sig[x]
            differ = np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
            ok = (HASHES - differ >= floor) & (comps != comps[x]) & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x]))
            ok &= (np.arange(len(rows)) > x) & (same | (block != block[x]))
            for y in np.flatnonzero(ok):
                if find(int(comps[x])) == find(int(comps[y])):
                    continue
                small, big = (sets[x], sets[y]) if sizes[x] < sizes[y] else (sets[y], sets[x])
                at = np.searchsorted(big, small)
                both = int((big[np.minimum(at, len(big) - 1)] == small).sum())
                if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                    out_a.append(int(ids[x]))
                    out_b.append(int(ids[y]))
                    up[find(int(comps[x]))] = find(int(comps[y]))
        return out_a, out_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        group = None
        for batch in batches:
            head = [(tuple(g.values()), *h) for g, *h in zip(*(batch.column(i).to_pylist() for i in range(7)))]
            for h, s in zip(head, shingle_sets(*string_buffer(batch.column(7)), k)):
                if h[:3] != group:
                    if len(held) > 1:
                        yield _pair_batch(*pairs(held))
                    group, held = h[:3], []
                held.append((h[3], h[4], h[5], h[6], s))
        if len(held) > 1:
            yield _pair_batch(*pairs(held))

    return run


def _pair_batch(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _exact_rest(now: DataFrame, texts: DataFrame, sigs: DataFrame, k: int, percent: int, all_: bool) -> tuple[DataFrame, DataFrame]:
    """Links between members of open buckets (key, id, c); without ``all_`` ids of clusters over BLOCK come back undone.

    With it a cluster of buckets is compared as one group, or each of its buckets by itself, whichever ships fewer copies
    of texts: a group of m documents takes m / BLOCK copies of each.
    """
    spark = texts.sparkSession
    comp = connected_components(now.select(F.col("lead").alias("a"), F.col("id").alias("b")))
    cluster = comp.select(F.col("v").alias("id"), F.col("component").alias("cluster"))
    # a row for each document, and one for each bucket: none for each place of a document in a bucket
    ids = materialize(now.select("id", "c").distinct().join(cluster.hint("merge"), "id").select("cluster", "id", "c"), "clustered")
    rows = F.expr(f"m * ceil(m / {BLOCK})")
    as_one = ids.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    if all_:
        keys = now.groupBy("key").agg(F.min("lead").alias("lead"), F.count(F.lit(1)).alias("m"))
        keys = materialize(keys.join(cluster.withColumnRenamed("id", "lead").hint("merge"), "lead").select("cluster", "key", "m"), "keys")
        apart = keys.groupBy("cluster").agg(F.sum(rows).alias("each"))
        size = materialize(as_one.select("cluster", rows.alias("one")).join(apart, "cluster").select("cluster", (F.col("one") <= F.col("each")).alias("whole")), "clusters")
        held = ids.join(size.where("whole").hint("merge"), "cluster").select(F.lit(True).alias("whole"), F.col("cluster").alias("key"), "id", "c")
        single = keys.join(size.where("not whole").hint("merge"), "cluster").select("key")
        held = held.unionByName(now.join(single.hint("merge"), "key").select(F.lit(False).alias("whole"), "key", "id", "c"))
        large = ids.limit(0).select("id")
        large.measured = {"n": 0}
    else:
        # a small cluster as one group: each of its documents goes to one task
        keys = None
        size = materialize(as_one.select("cluster", (F.col("m") > BLOCK).alias("large")), "clusters")
        sized = ids.join(size.hint("merge"), "cluster")
        large = materialize(sized.where("large").select("id"), "large", n=F.count(F.lit(1)))
        held = sized.where("not large").select(F.lit(True).alias("whole"), F.col("cluster").alias("key"), "id", "c")
    held = groups = materialize(held, "groups")
    blocks = materialize(held.groupBy("whole", "key").agg(F.expr(f"cast(ceil(count(1) / {BLOCK}) as int)").alias("nb")), "blocks")
    laid = held.join(blocks.hint("merge"), ["whole", "key"]).withColumn("block", F.expr("cast(pmod(xxhash64(id), nb) as int)"))
    laid = laid.withColumn("o", F.explode(F.expr("sequence(0, nb - 1)"))).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})
    group = F.struct("whole", "key").alias("group")
    rows = laid.join(sigs.hint("merge"), "id").join(texts.withColumnRenamed("doc_id", "id").hint("merge"), "id").select(group, "i", "j", "id", "c", "block", "sig", "text")
    rows = rows.repartition(width(spark), "group", "i", "j").sortWithinPartitions("group", "i", "j", "id")
    out = materialize(rows.mapInArrow(_compare(k, percent), "a long, b long"), "rest")
    discard(comp, ids, keys, size, groups, blocks)
    return out, large


def _plausible(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, n) those whose signatures come near enough, with their chunk."""
    p = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")).hint("merge"), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")).hint("merge"), "b")
    # a leader's partners in a bucket of n are dealt over n / CHUNK chunks
    chunk = F.expr(f"pmod(xxhash64(b), 1 + n div {CHUNK})").alias("chunk")
    return materialize(p.where(_estimate() >= _floor(percent / 100)).select("a", "b", chunk), "plausible")


def _apart(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members (key, id, n, lead) that are in another component than their bucket's leader."""
    own = comp.select(F.col("v").alias("id"), F.col("component").alias("c")).hint("merge")
    leader = comp.select(F.col("v").alias("lead"), F.col("component").alias("lc")).hint("merge")
    both = members.where("id <> lead").join(own, "id", "left").join(leader, "lead", "left")
    return materialize(both.where("coalesce(c, id) <> coalesce(lc, lead)").select("key", "id", "n", "lead"), "apart", m=F.count(F.lit(1)))


def _settle(members: DataFrame, comp: DataFrame, tested: DataFrame | None, texts: DataFrame, sigs: DataFrame, k: int, percent: int, fine: bool) -> DataFrame:
    """Components (v, component) after comparing what is still apart in buckets, first with their leaders."""

    def joined(links: DataFrame) -> DataFrame:
        return connected_components(comp.select(F.col("component").alias("a"), F.col("v").alias("b")).unionByName(links))

    apart = _apart(members, comp)
    if not apart.measured["m"]:
        return comp
    pairs = apart.groupBy(F.col("lead").alias("a"), F.col("id").alias("b")).agg(F.max("n").alias("n"))
    pairs = _plausible(pairs.join(tested.hint("merge"), ["a", "b"], "left_anti") if tested is not None else pairs, sigs, percent)
    comp = joined(_links(pairs, texts, k, percent))
    discard(apart, pairs)
    apart = _apart(members, comp)
    keys = materialize(apart.where("n > 2").select("key").distinct(), "open_keys", m=F.count(F.lit(1)))
    if keys.measured["m"]:
        own = comp.select(F.col("v").alias("id"), F.col("component").alias("c")).hint("merge")
        now = materialize(members.join(keys.hint("merge"), "key").join(own, "id", "left").select("key", "id", "lead", F.coalesce("c", "id").alias("c")), "open")
        rest, large = _exact_rest(now, texts, sigs, k, percent, all_=fine)
        comp = joined(rest)
        discard(now, rest)
        if large.measured["n"]:
            those = texts.join(large.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left_semi").select("doc_id", "text")
            finer = _members(materialize(those.mapInArrow(_fine(k), "id long, key long"), "fine"))
            comp = _settle(finer, comp, None, texts, sigs, k, percent, fine=True)
            discard(finer)
        discard(large)
    discard(apart, keys)
    return comp


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    docs: doc_id, text and any further columns (ignored). Documents are linked if 100 * |A and B| >= percent *
    |A or B| of their distinct k-word shingles (words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; with fewer than
    k words the whole sequence is one shingle). Null, empty and wordless texts have an empty set, are linked with
    nothing and stay. ``component_id`` is the least doc_id reachable over links; that row is ``kept``. Repeated rows of
    one doc_id share their result (if their texts differ, one of them speaks for the doc_id); rows of null doc_id are
    linked with nothing, have a null component and stay; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    signed = materialize(signatures(docs, k), "signed")
    named = F.expr("set_key is not null and doc_id is not null")
    rep = materialize(signed.where(named).groupBy("set_key").agg(F.min("doc_id").alias("rep")), "rep")
    of_set = signed.where(named).select("doc_id", "n_shingles", "set_key").join(rep.hint("merge"), "set_key").select("doc_id", "n_shingles", "rep")
    classes = materialize(of_set.unionByName(signed.where(~named).select("doc_id", "n_shingles", F.col("doc_id").alias("rep"))), "classes")
    heads = signed.where(named).join(classes.where("doc_id = rep").select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    members = _members(materialize(heads.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key")), "banded"))
    discard(rep)
    involved = materialize(members.select(F.col("id").alias("doc_id")).distinct(), "involved")
    # any row of a repeated doc_id; equal rows have equal texts. Always a merge join: the plan is the same at every size
    texts = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(involved.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    sigs = materialize(signed.join(involved.hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "sig").dropDuplicates(["id"]), "sigs")
    discard(signed)

    # one pair a document: with the least leader of its buckets, which is the lesser of the two
    first = members.where("id <> lead").groupBy(F.col("id").alias("b")).agg(F.min(F.struct("lead", (-F.col("n")).alias("less"))).alias("m"))
    tested = _plausible(first.select(F.col("m.lead").alias("a"), "b", (-F.col("m.less")).alias("n")), sigs, percent)
    links = _links(tested, texts, k, percent)
    comp = _settle(members, connected_components(links), tested, texts, sigs, k, percent, fine=False)
    discard(tested, members, involved, texts, sigs)
    out = classes.join(comp.withColumnRenamed("v", "rep").hint("merge"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = materialize(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near")
    discard(classes, comp, links)
    return out


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps (and those of null doc_id), with all their columns."""
    gone = materialize(near_duplicates(docs, k, percent).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti")


#: All pairs that share a shingle, and the closure of their links.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + least(len(w), 2) - 1] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 2) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, n, dense_rank() OVER (ORDER BY s) AS s FROM s JOIN n USING (doc_id)),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
c AS (SELECT v, min(u) AS c FROM r GROUP BY v)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.v = doc_id
"""
