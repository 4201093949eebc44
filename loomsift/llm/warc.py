"""WARC archives with a two-level capture index.

Pages are written as WARC/1.1 records, one gzip member each, into rolled archive files; a page whose payload (of
``REVISIT_BYTES`` or more) another page of smaller page_id has is a revisit of that page. The capture index sorts keys
(reversed host, path, query; then page_id) by sampled range partitions into compressed blocks of ``BLOCK_LINES``
lines; beside each shard lies a sparse directory of its blocks. A lookup searches the shards' first keys, then one
shard's directory, then one decompressed block by binary search, and reads the record by its byte range.

Files go through ``pyarrow.fs`` to the shared folder. Their names carry a fresh id for each task attempt, and only files
whose attempt succeeded are named in the tables, so lost or repeated attempts do no harm.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches, discard, materialize, remove, shared_dir, width

REVISIT_BYTES, BLOCK_LINES = 100, 500
ARCHIVE_BYTES = 64 << 20
#: Revisits up to which (page_id, digest, page_id) is broadcast: 100 bytes or so each.
REVISITS = 500_000
_URN = "urn:loomsift:page:"
NONE = -(1 << 63)
CAPTURE = "page_id long, url string, file string, offset long, length long, payload_digest string"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _line(value: object) -> str:
    """A header value: control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response (payload given) or revisit record. A revisit holds the HTTP header with the full payload's length only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{page_id if page_id is not None else f'none:{uuid.uuid4()}'}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; the digest of a response is computed from its payload, a revisit's read from its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    own = fields["WARC-Type"] == "response"
    ref = fields.get("WARC-Refers-To")
    return {
        "page_id": None if (own_id := fields["WARC-Record-ID"][1 + len(_URN) : -1]).startswith("none:") else int(own_id),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": len(payload) if own else length,
        "payload_digest": hashlib.sha256(payload).hexdigest() if own else fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "record_type": fields["WARC-Type"],
        "refers_to": int(ref[1 + len(_URN) : -1]) if ref else None,
        "payload": payload if own else None,
        "declared": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
    }


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        attempt, part = uuid.uuid4().hex, 0
        out, at, name = None, 0, ""
        try:
            for batch in batches:
                rows = []
                for page, url, html, size, digest, ref in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        name = f"{attempt}-{part:05d}.warc.gz"
                        out, at, part = fs.open_output_stream(f"{root}/{name}", compression=None), 0, part + 1
                    z = zlib.compressobj(5, zlib.DEFLATED, 31)
                    member = z.compress(record(page, url, (html or "").encode(), size, digest, ref, date)) + z.flush()
                    out.write(member)
                    rows.append((page, url, name, at, len(member), digest))
                    at += len(member)
                    if at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                cols = list(zip(*rows)) or [()] * 6
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["page_id", "url", "file", "offset", "length", "payload_digest"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, str]:
    """(captures: page_id, url, file, offset, length, payload_digest; folder).

    A null html is an empty payload, a null url leaves its header out, a page of null page_id is a response under an id of
    its own. Rows that repeat a page_id are written one by one; further columns are ignored; an empty table writes nothing.

    Only ids and digests are shuffled to find the revisits. Up to REVISITS of them are broadcast, so that each page is
    written where it lies; beyond that pages are joined by page_id, of which no value is frequent.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = f"{shared_dir(spark)}/loomsift/warc-{uuid.uuid4().hex}"
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    long = materialize(rows.where(f"size >= {REVISIT_BYTES} and page_id is not null").select("page_id", "digest"), "digests")
    first = materialize(long.groupBy("digest").agg(F.min("page_id").alias("ref"), F.max("page_id").alias("last")).where("ref < last").drop("last"), "first")
    # both sides are tables, so that adaptive execution can split a digest that many pages have
    again = long.join(first.hint("merge"), "digest").where("ref < page_id").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "ref").distinct()
    again = materialize(again, "revisits", n=F.count(F.lit(1)))
    hint = F.broadcast if again.measured["n"] <= REVISITS else (lambda t: t.hint("merge"))
    rows = rows.join(hint(again), (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.select("page_id", "url", F.expr("case when ref is null then html end").alias("html"), "size", "digest", "ref")
    out = materialize(rows.mapInArrow(_write(folder, date), CAPTURE), "captures")
    discard(long, first, again)
    return out, folder


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[dict] = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    z, raw = zlib.decompressobj(31), b""
                    chunk = f.read(1 << 20)
                    while chunk:
                        raw += z.decompress(chunk)
                        chunk = z.unused_data
                        if z.eof:
                            rows.append(parse_record(raw))
                            rows[-1].pop("payload")
                            z, raw = zlib.decompressobj(31), b""
                        if not chunk:
                            chunk = f.read(1 << 20)
                yield _readings(rows)

    return run


READING = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _readings(rows: list[dict]) -> pa.RecordBatch:
    cols = [pa.array([r[k] for r in rows], t) for k, t in (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))]
    cols.append(pa.array([r["declared"] == r["payload_digest"] for r in rows], pa.bool_()))
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in READING.split(", ")])


def read_archives(captures: DataFrame, folder: str) -> DataFrame:
    """Every record of the archive files that ``captures`` names, read sequentially, a file (64 MB or so) a step."""
    files = captures.select("file").distinct()
    return files.repartition(width(captures.sparkSession), "file").mapInArrow(_read(folder), READING)


def key(url: Column) -> Column:
    """Sort key: reversed host, port, path and query; the fragment is left out. What is no URL is its own key."""
    host = F.array_join(F.reverse(F.split(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\.")), ",")
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    return F.coalesce(F.concat(host, F.lit(")"), rest), url, F.lit(""))


def _index(folder: str):
    """Sorted captures -> a shard of compressed blocks and its directory; one row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        name = f"{uuid.uuid4().hex}.cdx"
        out, at, lines, blocks = None, 0, [], []

        def flush() -> None:
            nonlocal at, lines
            body = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 5)
            out.write(body)
            blocks.append([lines[0][:2], at, len(body)])
            at, lines = at + len(body), []

        n, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                lines.append(row)
                last, n = row, n + 1
                if len(lines) >= BLOCK_LINES:
                    flush()
        if n:
            if lines:
                flush()
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as d:
                d.write(zlib.compress(json.dumps(blocks).encode()))
            row = [[blocks[0][0][0]], [blocks[0][0][1]], [last[0]], [name], [n]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["first_key", "first_page", "last_key", "shard", "lines"])

    return run


class CaptureIndex:
    """The index over ``captures``. ``shards`` holds one row for each range partition, whatever the number of captures."""

    def __init__(self, captures: DataFrame, folder: str) -> None:
        self.folder = folder
        spark = captures.sparkSession
        # a null page_id sorts, and is looked up, as the least number
        page = F.coalesce("page_id", F.lit(NONE)).cast("long").alias("page_id")
        rows = captures.select(key(F.col("url")).alias("k"), page, "file", "offset", "length", "payload_digest")
        rows = rows.repartitionByRange(width(spark), "k", "page_id").sortWithinPartitions("k", "page_id")
        table = materialize(rows.mapInArrow(_index(folder), "first_key string, first_page long, last_key string, shard string, lines long"), "shards")
        self.shards = sorted(((r["first_key"].encode(), r["first_page"], r["last_key"].encode(), r["shard"]) for r in table.collect()), key=lambda s: s[:2])

    def lookup(self, queries: DataFrame) -> DataFrame:
        """queries (url, page_id or null for all captures of the url) -> the records found, as :func:`read_archives` gives."""
        spark = queries.sparkSession
        keyed = queries.select(key(F.col("url")).alias("k"), F.col("page_id").cast("long").alias("page_id"))
        # neighbours read the same blocks
        keyed = keyed.repartitionByRange(width(spark), "k", "page_id").sortWithinPartitions("k", "page_id")
        shards, folder = self.shards, self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(shards, folder)
            for batch in batches:
                found = [r for k, p in zip(*(c.to_pylist() for c in batch.columns)) for r in reader.find(k, p)]
                yield _readings(found)

        return keyed.mapInArrow(run, READING)


class Reader:
    def __init__(self, shards: list[tuple], folder: str) -> None:
        self.fs, self.root = _open(folder)
        self.shards = shards
        self.firsts = [s[0] for s in shards]
        self.directory = lru_cache(64)(self._directory)
        self.block = lru_cache(16)(self._block)
        self.open = lru_cache(16)(lambda name: self.fs.open_input_file(f"{self.root}/{name}"))

    def _directory(self, shard: str) -> list:
        with self.fs.open_input_stream(f"{self.root}/{shard}.dir", compression=None) as f:
            return [((k.encode(), p), at, n) for (k, p), at, n in json.loads(zlib.decompress(f.read()))]

    def _block(self, shard: str, at: int, n: int) -> list:
        f = self.open(shard)
        f.seek(at)
        return [((x[0].encode(), x[1]), *x[2:]) for x in map(json.loads, zlib.decompress(f.read(n)).decode().split("\n"))]

    def lines(self, k: str, page: int | None) -> Iterator[tuple]:
        """Index lines of a key (and page): three binary searches, then a scan of neighbours."""
        low = (k.encode(), page if page is not None else NONE)
        high = (k.encode(), page if page is not None else 1 << 63)
        i = max(bisect_left(self.firsts, low[0]) - 1, 0)
        while i < len(self.shards) and self.firsts[i] <= high[0]:
            shard, last = self.shards[i][3], self.shards[i][2]
            i += 1
            if last < low[0]:
                continue
            blocks = self.directory(shard)
            j = max(bisect_left(blocks, low, key=lambda b: b[0]) - 1, 0)
            while j < len(blocks) and blocks[j][0] <= high:
                rows = self.block(shard, blocks[j][1], blocks[j][2])
                a, b = bisect_left(rows, low, key=lambda r: r[0]), bisect_right(rows, high, key=lambda r: r[0])
                yield from rows[a:b]
                j += 1

    def find(self, k: str, page: int | None) -> Iterator[dict]:
        for _, name, at, n, _ in self.lines(k, page):
            f = self.open(name)
            f.seek(at)
            got = parse_record(zlib.decompress(f.read(n), 31))
            got.pop("payload")
            yield got


def archive_report(pages: DataFrame, every: int = 20) -> DataFrame:
    """Write, read back and index ``pages``: READING columns, and for page_ids divisible by ``every`` whether the index finds them.

    One row a page, repeated ones too; null ids, urls and html as :func:`write_archives` says. The archives are removed
    once the report is written.
    """
    captures, folder = write_archives(pages)
    back = read_archives(captures, folder)
    index = CaptureIndex(captures, folder)
    asked = captures.where(F.col("page_id") % every == 0).select("url", "page_id").distinct()
    hits = index.lookup(asked).where("intact").groupBy("page_id").agg(F.max("payload_digest").alias("by_index"))
    out = back.join(hits.hint("merge"), "page_id", "left")
    found = F.when(F.col("page_id") % every == 0, F.coalesce(F.col("by_index") == F.col("payload_digest"), F.lit(False)))
    out = materialize(out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", found.alias("indexed")), "report")
    discard(captures)
    remove(pages.sparkSession, folder)
    return out


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS least FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, d.h AS payload_digest, CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN least < page_id THEN least END AS refers_to, TRUE AS intact, CASE WHEN page_id % 20 = 0 THEN TRUE END AS indexed
FROM d LEFT JOIN f ON f.h = d.h
"""
