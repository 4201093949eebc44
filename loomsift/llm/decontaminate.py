"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

A test item is contained in a document if at least ``THRESHOLD`` of the item's distinct 5-word shingles occur in it. An
item of fewer words is one shingle of its own length, and documents are searched at the few lengths that such items have.
Items are partitioned by size. An item's signature is the bottom of its shingle hashes (a bottom-k MinHash), and k is
set from the size of its partition's largest item such that at the threshold one of the k minima must occur in the
document: k = floor((1 - THRESHOLD) * n) + 1. Every document's shingles are probed against the signatures, so a short
item is found in a document of any length, without a false negative; candidates are then verified by the exact share
of the item's shingles. (A signature of the document, as the usual domain search keeps, can't do this: a 40-word item
in a 20,000-word text has a Jaccard similarity of 0.002.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import discard, materialize

WORDS, THRESHOLD = 5, 0.8
#: Shingles of all items up to which their table is broadcast (16 bytes each); beyond, joins shuffle.
BROADCAST_SHINGLES = 1_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(rows: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """(key, h): each shingle of one of ``lengths`` words, repeats included."""
    split = rows.select(F.col(key), words(F.col("text")).alias("w"))
    out = None
    for k in lengths:
        each = split.where(F.size("w") >= k).select(key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("i"))
        some = each.select(key, F.xxhash64(*[F.get("w", F.col("i") + j) for j in range(k)]).alias("h"))
        out = some if out is None else out.unionByName(some)
    return out


def _ceiling() -> Column:
    """Smallest number of shared shingles that reaches the threshold."""
    return F.expr(f"cast(ceil(n * {THRESHOLD} - 1e-9) as int)")


def item_tables(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets: item_id, n, hs, k; the lengths of their shingles). ``sets.measured`` has the number of all shingles."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    sized = rows.withColumn("len", F.least(F.size(words(F.col("text"))), F.lit(WORDS)))
    lengths = sorted(r["len"] for r in sized.select("len").where("len > 0").distinct().collect())  # WORDS rows at most
    full = None
    for k in lengths:
        some = _shingles(sized.where(F.col("len") == k), "item_id", [k])
        full = some if full is None else full.unionByName(some)
    full = (full if full is not None else _shingles(rows.limit(0), "item_id", [WORDS])).distinct()
    sets = full.groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    sets = sets.withColumn("n", F.size("hs")).withColumn("part", F.expr("cast(ceil(log2(n)) as int)"))
    largest = sets.groupBy("part").agg(F.max("n").alias("most"))
    sets = sets.join(F.broadcast(largest), "part")  # at most 31 rows
    k = F.expr(f"least(n, cast(floor(most * (1 - {THRESHOLD}) + 1e-9) as int) + 1)").alias("k")
    return materialize(sets.select("item_id", "n", "hs", k), "items", s=F.sum("n")), lengths or [WORDS]


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles): items of which at least THRESHOLD occurs in the document."""
    sets, lengths = item_tables(items)
    full = sets.select("item_id", "n", F.explode("hs").alias("h"))
    signature = sets.select("item_id", F.explode(F.expr("slice(hs, 1, k)")).alias("h"))
    hint = F.broadcast if (sets.measured["s"] or 0) <= BROADCAST_SHINGLES else (lambda t: t)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = materialize(_shingles(rows, "doc_id", lengths).join(hint(signature), "h").select("doc_id", "item_id").distinct(), "candidates")
    texts = rows.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    hits = _shingles(texts, "doc_id", lengths).join(hint(full), "h").groupBy("doc_id", "item_id", "n").agg(F.count_distinct("h").cast("int").alias("shared"))
    hits = hits.where(F.col("shared") >= _ceiling()).join(found, ["doc_id", "item_id"], "left_semi")
    hits = materialize(hits.select("doc_id", "item_id", "shared", F.col("n").alias("item_shingles")), "hits")
    discard(sets, found)
    return hits


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids) of every document.

    Null and wordless texts contain nothing and can't be found; rows of null doc_id are taken as clean, items of null
    item_id are left out; rows that repeat a doc_id or an item_id are taken together (repeated items of different lengths
    as one set); empty tables give no finding. Further columns are ignored.
    """
    per = contained_items(docs, items).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(per, "doc_id", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.concat_ws(",", F.col("item_ids").cast("array<string>")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    bad = materialize(contained_items(docs, items).select(F.col("doc_id").alias("loomsift_id")).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id").cast("long") == F.col("loomsift_id"), "left_anti")


SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k),
bs AS (SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM b WHERE len(w) > 0),
dh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS h FROM ds),
bh AS (SELECT DISTINCT item_id, array_to_string(w[i:i + k - 1], ' ') AS h FROM bs),
bn AS (SELECT item_id, count(*) AS n FROM bh GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS shared FROM dh JOIN bh USING (h) GROUP BY ALL),
ok AS (SELECT doc_id, item_id FROM hit JOIN bn USING (item_id) WHERE shared >= ceil(n * 0.8 - 1e-9)),
per AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids FROM ok GROUP BY doc_id)
SELECT d.doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0)::BIGINT AS n_items, coalesce(ids, '') AS item_ids
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id
"""
