"""Line deduplication across documents by pairwise alignment.

A line is hashed in context: with the lines after it (and, a second time, with those before it) until the run holds
``MIN_BLOCK_WORDS`` words, so that short lines count too and equal hashes mean an equal run of consecutive lines. Of
these runs the rare ones (at most ``RARE`` places in all documents) pair a document with the first holder of each, and
the pair that shares most rare runs is the document's main pair. Frequent runs pair nobody: they take part in the main
pair's alignment, and only where the main partner lacks one is it taken to its own first holder. So each run of a
document is tried in one pair, or two, however many documents hold it, and none is left out.

A pair is aligned by patience diff: runs unique in both are matched along their longest increasing subsequence, repeated
ones fill the gaps. Matches whose places advance together in both documents form a block. What crosses the alignment is
aligned again by itself, as a moved block. All blocks are deleted from the later document (the one of larger doc_id);
each is, by its runs, ten words or more that stand as consecutive lines in the earlier document.

In sum a line goes if it belongs to a run of consecutive lines, ten words or more together, that an earlier document
holds as consecutive lines, which is what :data:`SQL` says.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches, discard, materialize, width

MIN_BLOCK_WORDS = 10
#: Places in all documents up to which a run of lines is rare.
RARE = 16
SPACE = " \t\r\x0b\x0c"
#: Scripts written without spaces: each code point counts as a word.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
_CLASS = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED)
_WORD = re.compile(f"[{_CLASS}]|[^\x20\x09-\x0d{_CLASS}]+")
_WIDE = re.compile(rb"[\xe0-\xef]")
RUNS = "doc_id long, mark long, at int, n int, run binary"


def lines_of(text: bytes) -> tuple[list[bytes], list[int]]:
    """The lines that hold words, without outer white space, and their words."""
    wide = _WIDE.search(text) is not None
    lines, words = [], []
    for line in text.split(b"\n"):
        n = len(_WORD.findall(line.decode())) if wide else len(line.split())
        if n:
            lines.append(line.strip(SPACE.encode()))
            words.append(n)
    return lines, words


def runs_of(words: list[int]) -> list[tuple[int, int]]:
    """(first line, lines) of the shortest runs of MIN_BLOCK_WORDS from each line on, and up to each line."""
    out = set()
    end, total = 0, 0
    for start in range(len(words)):
        while end < len(words) and total < MIN_BLOCK_WORDS:
            total += words[end]
            end += 1
        if total < MIN_BLOCK_WORDS:
            break
        out.add((start, end - start))
        total -= words[start]
    start, total = 0, 0
    for end in range(len(words)):
        total += words[end]
        while total - words[start] >= MIN_BLOCK_WORDS:
            total -= words[start]
            start += 1
        if total >= MIN_BLOCK_WORDS:
            out.add((start, end - start + 1))
    return sorted(out)


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import blake2b

    for batch in batches:
        rows: list[tuple] = []
        for doc, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
            lines, words = lines_of(text)
            for at, n in runs_of(words):
                run = lines[at] if n == 1 else b"\n".join(lines[at : at + n])
                rows.append((doc, mark, at, n, blake2b(run, digest_size=16).digest()))
        cols = list(zip(*rows)) or [()] * 5
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "mark", "at", "n", "run"])


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of (b, a), sorted by b, along which a rises."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, a) in enumerate(pairs):
        k = bisect_left(tails, a)
        if k == len(tails):
            tails.append(a)
            at.append(i)
        else:
            tails[k], at[k] = a, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(mine: dict[bytes, list[int]], theirs: dict[bytes, list[int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Places of shared keys in a later and an earlier document -> (aligned, crossing) matches (b, a).

    Keys unique in both are the anchors. Of a repeated key the k-th places match within each gap between anchors. Every
    place b has one match, aligned or crossing.
    """
    shared = mine.keys() & theirs.keys()
    anchors = _rising(sorted((mine[k][0], theirs[k][0]) for k in shared if len(mine[k]) == len(theirs[k]) == 1))
    fences = [b for b, _ in anchors]
    seen: Counter = Counter()
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for b, k in sorted((b, k) for k in shared if len(mine[k]) > 1 or len(theirs[k]) > 1 for b in mine[k]):
        g = bisect_left(fences, b)
        low = anchors[g - 1][1] if g else -1
        places = theirs[k]
        i = bisect_left(places, low) + seen[g, k]
        seen[g, k] += 1
        if i < len(places) and (g == len(anchors) or places[i] <= anchors[g][1]):
            gaps[g].append((b, places[i]))
    aligned = sorted(anchors + [m for gap in gaps.values() for m in _rising(gap)])
    taken = {b for b, _ in aligned}
    crossing = sorted((b, theirs[k][min(i, len(theirs[k]) - 1)]) for k in shared for i, b in enumerate(mine[k]) if b not in taken)
    return aligned, crossing


def blocks(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Matches (b, a, lines), sorted -> blocks whose places advance together in both documents."""
    out: list[list[int]] = []
    for b, a, n in matches:
        if out and b <= out[-1][0] + out[-1][2] and b - a == out[-1][0] - out[-1][1]:
            out[-1][2] = max(out[-1][2], b + n - out[-1][0])
        else:
            out.append([b, a, n])
    return [tuple(x) for x in out]


def pair_blocks(rows: list[tuple[int, int, bytes, list[int]]]) -> list[tuple[int, int, int, bool]]:
    """Runs (place, lines, run, places in the earlier document) of one pair -> blocks (b, a, lines, moved)."""
    # equal runs have as many lines, MIN_BLOCK_WORDS at most, so runs of one place are told apart by them
    k = MIN_BLOCK_WORDS + 1
    mine: dict[bytes, list[int]] = defaultdict(list)
    theirs: dict[bytes, list[int]] = {}
    for b, n, run, places in sorted(rows):
        mine[run].append(b * k + n)
        theirs[run] = [a * k + n for a in places]
    out = []
    for matches, moved in zip(align(mine, theirs), (False, True)):
        out += [(*x, moved) for x in blocks([(b // k, a // k, b % k) for b, a in matches])]
    return sorted(out)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows sorted by their first ``keys`` columns, those of equal keys together."""
    held: list[tuple] = []
    key = None
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if r[:keys] != key:
                if held:
                    yield key, held
                key, held = r[:keys], []
            held.append(r[keys:])
    if held:
        yield key, held


BLOCKS = "doc_id long, mark long, earlier long, at int, lines int, earlier_at int, moved boolean"


def _align_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 7
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in BLOCKS.split(", ")])

    out: list[tuple] = []
    for (doc, mark, earlier), rows in _groups(batches, 3):
        out += [(doc, mark, earlier, b, n, a, moved) for b, a, n, moved in pair_blocks(rows)]
        if len(out) > 4096:
            yield flush(out)
            out = []
    yield flush(out)


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, mark (tells apart rows that repeat a doc_id with other texts) and text as bytes, of rows that have both."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.where("doc_id is not null and text is not null")


def common_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, earlier, at, lines, earlier_at, moved): blocks of lines that a document shares with an earlier one.

    ``at`` and ``earlier_at`` number the lines that hold words, from 0. The table lies in the shared folder.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    runs = materialize(_identified(docs).mapInArrow(_run_rows, RUNS), "runs")
    # tables on both sides of a join, so that adaptive execution can split the partition of a frequent run
    held = materialize(runs.groupBy("run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("places")).where("first < last").drop("last"), "held")
    shared = materialize(runs.join(held.hint("merge"), "run"), "shared")
    discard(runs, held)
    later = shared.where("first < doc_id")
    rare = F.col("places") <= RARE
    votes = later.where(rare).groupBy("doc_id", "mark", "first").agg(F.count(F.lit(1)).alias("votes"))
    main = materialize(votes.groupBy("doc_id", "mark").agg(F.min_by("first", F.struct(-F.col("votes"), F.col("first"))).alias("main")), "main")
    places = shared.where(~rare | (F.col("first") == F.col("doc_id"))).groupBy("doc_id", "run").agg(F.sort_array(F.collect_set("at")).alias("theirs"))
    places = materialize(places.withColumnRenamed("doc_id", "earlier"), "places")
    asked = later.join(main.hint("merge"), ["doc_id", "mark"], "left").withColumn("earlier", F.when(rare, F.col("first")).otherwise(F.coalesce("main", "first"))).drop("main")
    # what the main partner lacks goes on to the run's first holder
    tried = materialize(asked.join(places.hint("merge"), ["earlier", "run"], "left"), "tried")
    rest = tried.where("theirs is null").select(*[c for c in tried.columns if c not in ("earlier", "theirs")], F.col("first").alias("earlier"))
    rest = rest.join(places.hint("merge"), ["earlier", "run"])
    cols = ["doc_id", "mark", "earlier", "at", "n", "run", "theirs"]
    pairs = tried.where("theirs is not null").select(*cols).unionByName(rest.select(*cols))
    pairs = pairs.repartition(width(spark), "doc_id", "mark", "earlier").sortWithinPartitions("doc_id", "mark", "earlier")
    out = materialize(pairs.mapInArrow(_align_rows, BLOCKS), "blocks")
    discard(shared, main, places, tried)
    return out


def apply_cut(text: bytes, cut: list[int]) -> tuple[bytes, int]:
    """``text`` without the lines of blocks (first line, lines, first line, ...), and how many went.

    Blank lines go with the line before them.
    """
    gone = set()
    for at, n in zip(cut[::2], cut[1::2]):
        gone.update(range(at, at + n))
    out, unit = [], -1
    for line in text.split(b"\n"):
        unit += bool(line.strip(SPACE.encode()))
        if unit not in gone:
            out.append(line)
    return b"\n".join(out), len(gone)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cuts = batch.column("loomsift_cut").to_pylist()
        if any(cuts):
            i, j = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_cut")
            done = [apply_cut(t.encode(), c) if c else (t, 0) for t, c in zip(batch.column(i).to_pylist(), cuts)]
            # with the batch's own fields: all batches of a task go into one stream, those without cuts unchanged
            for at, values in zip((i, j), zip(*done)):
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
        yield batch


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated blocks deleted and three further columns: chars_before, chars_after, n_cut (lines).

    Of documents that share lines the one of least doc_id keeps them. Lines are compared without outer white space, by
    a 128-bit cryptographic hash of whole runs. Null texts stay null, empty texts empty, and both are in no pair, like
    rows of null doc_id; rows that repeat a doc_id aren't compared with each other; lines repeated within one document
    stay; an empty table gives an empty result. Further columns pass through (``chars_before``, ``chars_after``,
    ``n_cut`` and names that begin with ``loomsift_`` are replaced).
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("chars_before", "chars_after", "n_cut") and not c.startswith("loomsift_")]
    docs = docs.select(*names).withColumn("text", F.col("text").cast("string"))
    found = common_blocks(docs)
    cut = found.groupBy(F.col("doc_id").alias("loomsift_id"), F.col("mark").alias("loomsift_mark")).agg(F.sort_array(F.collect_set(F.struct("at", "lines"))).alias("spans"))
    cut = materialize(cut.select("loomsift_id", "loomsift_mark", F.flatten(F.transform("spans", lambda s: F.array(s["at"], s["lines"]))).alias("loomsift_cut")), "cut")
    discard(found)
    out = docs.withColumns({"chars_before": F.coalesce(F.length("text"), F.lit(0)).cast("long"), "n_cut": F.lit(0).cast("long"), "loomsift_id": F.col("doc_id").cast("long"), "loomsift_mark": F.xxhash64("text")})
    # always a merge join: the plan is the same at every size
    out = out.join(cut.hint("merge"), ["loomsift_id", "loomsift_mark"], "left").select(*names, "chars_before", "n_cut", "loomsift_cut")
    return out.mapInArrow(_rewrite, out.schema).withColumn("chars_after", F.coalesce(F.length("text"), F.lit(0)).cast("long")).drop("loomsift_cut")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with their own columns after :func:`dedup_lines`, without documents of which nothing is left.

    ``n_chars``, if there, is brought up to date for texts that changed.
    """
    out = dedup_lines(docs).where(~((F.col("n_cut") > 0) & (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) == 0)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_cut") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[c for c in docs.columns if c in out.columns])


_RE2 = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in UNSPACED)
SQL = rf"""
WITH l AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[{_RE2}]|[^\x20\x09-\x0D{_RE2}]+')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
u AS (SELECT *, sum(least(w, 1)) OVER (PARTITION BY doc_id ORDER BY i) AS unit FROM l),
t AS (SELECT doc_id, unit, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto, upto - w AS before FROM u WHERE w > 0),
s AS (SELECT a.doc_id, a.unit AS s, b.unit AS e FROM t a ASOF JOIN t b ON a.doc_id = b.doc_id AND a.before + {MIN_BLOCK_WORDS} <= b.upto
  UNION SELECT b.doc_id, a.unit, b.unit FROM t b ASOF JOIN t a ON a.doc_id = b.doc_id AND b.upto - {MIN_BLOCK_WORDS} >= a.before),
r AS (SELECT s.doc_id, s, e, string_agg(line, chr(10) ORDER BY unit) AS run FROM s JOIN t ON t.doc_id = s.doc_id AND unit BETWEEN s AND e GROUP BY ALL),
f AS (SELECT run, min(doc_id) AS first FROM r GROUP BY run),
c AS (SELECT DISTINCT r.doc_id, unnest(range(s::BIGINT, e::BIGINT + 1)) AS unit FROM r JOIN f USING (run) WHERE first < r.doc_id),
k AS (SELECT u.doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (c.unit IS NULL) AS text, count(DISTINCT c.unit) AS n_cut FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.unit = u.unit GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(n_cut, 0)::BIGINT AS n_cut, coalesce(length(d.text), 0)::BIGINT AS chars_before, coalesce(length(k.text), 0)::BIGINT AS chars_after,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS text_sha256, coalesce(n_cut, 0) > 0 AS changed FROM documents d LEFT JOIN k USING (doc_id)
"""
