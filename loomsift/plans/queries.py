"""The engine's queries by name, and the SQL each can be checked with."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..formats.registry import HANDLER_OF, HANDLERS, MIME_OF, OTHER, SUPPORTED
from ..functions import members as M
from ..functions import names as N
from ..functions import states as S
from ..functions import text as T
from ..operators import files as ops
from ..operators import store
from ..options import Options
from ..streaming import fold
from . import expected as E
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- pages: HTML ----
def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("file_id"), F.lit("page.html").alias("filename"), F.lit("text/html").alias("mime_type"), F.col("html").cast("binary").alias("body"))


def _page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.metadata_items(ops.process(_pages(spark, sf_dir))).withColumnRenamed("file_id", "page_id")


_ITEMS = """WITH p AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, regexp_extract(html, '<style>(.*?)</style>', 1, 's') AS style,
  regexp_extract(html, '<script>(.*?)</script>', 1, 's') AS script FROM pages),
i AS (SELECT page_id, unnest([{'o': 0, 'key': '(meta)', 'value': ''}, {'o': 1, 'key': 'title', 'value': trim(title)}, {'o': 2, 'key': '<style>', 'value': 'inline (' || strlen(style) || ' bytes)'},
  {'o': 3, 'key': '<script>', 'value': 'inline (' || strlen(script) || ' bytes)'}]) AS x FROM p),
items AS (SELECT page_id, x.o AS item_ord, x.key AS key, x.value AS value FROM i)
"""


@query(_ITEMS + "SELECT page_id, item_ord::BIGINT AS item_ord, key, value FROM items")
def html_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_items(spark, sf_dir).select("page_id", F.col("item_ord").cast("long").alias("item_ord"), "key", "value")


@query(_ITEMS + "SELECT key, count(*)::BIGINT AS n, sum(strlen(value))::BIGINT AS value_bytes FROM items GROUP BY key")
def html_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_items(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).cast("long").alias("value_bytes"))


@query(_ITEMS + "SELECT page_id, value AS title FROM items WHERE key = 'title'")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_items(spark, sf_dir).where("key = 'title'").select("page_id", F.col("value").alias("title"))


@query("SELECT page_id, strlen(regexp_extract(html, '<script>(.*?)</script>', 1, 's'))::BIGINT AS script_bytes FROM pages")
def html_inline_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The well-formed subset by built-in expressions alone."""
    body = F.regexp_extract("html", r"(?is)<script[^>]*>(.*?)</script[\s/>]", 1)
    return _table(spark, sf_dir, "pages").select("page_id", F.octet_length(body).cast("long").alias("script_bytes"))


_CLEAN = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script>.*?</script>', '', 'gs'), '<style>.*?</style>', '', 'gs'),
  '<!--.*?-->', '', 'gs'), '<meta[^>]*>', '', 'g'), '<title>.*?</title>', '<title></title>', 'gs')"""


@query(f"SELECT page_id, {_CLEAN} AS html FROM pages")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ops.process(_pages(spark, sf_dir), read=False, clean=True)
    return done.select(F.col("file_id").alias("page_id"), F.col("cleaned").cast("string").alias("html"))


@query("SELECT page_id, TRUE AS same FROM pages")
def html_clean_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.recheck(_pages(spark, sf_dir), read=False).select(F.col("file_id").alias("page_id"), "same")


@query("SELECT page_id, 0::BIGINT AS n_items FROM pages")
def html_read_after_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = ops.recheck(_pages(spark, sf_dir), clean=False)
    return again.select(F.col("file_id").alias("page_id"), S.total_count(F.col("groups")).alias("n_items"))


@query("SELECT page_id, 'HasMetadata' AS state, 'has-metadata' AS simple_state, 4::BIGINT AS item_count FROM pages")
def file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.file_results(ops.process(_pages(spark, sf_dir))).select(F.col("file_id").alias("page_id"), "state", "simple_state", "item_count")


# ---- literal files of one format each ----
def _files(spark: SparkSession, rows: list, name: str) -> DataFrame:
    from ..formats.registry import mime_of

    data = [(r[0], name, mime_of(name), r[1].encode() if isinstance(r[1], str) else r[1]) for r in rows]
    return spark.createDataFrame(data, "file_id long, filename string, mime_type string, body binary")


def _items_of(rows: list, name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = ops.process(_files(spark, rows, name))
        return ops.metadata_items(p).select(F.col("file_id").alias("id"), F.col("item_ord").cast("long").alias("item_ord"), "key", "value")

    flat = [(r[0], i, k, v) for r in rows for i, (k, v) in enumerate(r[2] or [])]
    return run, f"WITH {X.Literal('x', 'id long, item_ord long, key string, value string', flat).cte()} SELECT * FROM x"


def _clean_of(rows: list, name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = ops.process(_files(spark, rows, name), read=False, clean=True)
        return p.select(F.col("file_id").alias("id"), F.lower(F.hex("cleaned")).alias("body"), F.col("clean_error_class").isNotNull().alias("failed"))

    flat = [(r[0], None if r[-1] is None else (r[-1].encode() if isinstance(r[-1], str) else r[-1]).hex(), r[-1] is None) for r in rows]
    return run, f"WITH {X.Literal('x', 'id long, body string, failed boolean', flat).cte()} SELECT * FROM x"


for _name, _rows, _file, _reads, _cleans in [
    ("html_adversarial", X.HTML, "p.html", True, True), ("css", X.CSS, "p.css", True, True), ("svg", X.SVG, "p.svg", True, True), ("bencode", X.BENCODE, "p.torrent", True, True), ("gif", X.GIF, "p.gif", True, True),
    ("jpeg", X.JPEG, "p.jpg", False, True), ("png", X.PNG, "p.png", False, True),
]:
    if _reads:
        QUERIES[f"{_name}_items"], SQL[f"{_name}_items"] = _items_of(_rows, _file)
    if _cleans:
        QUERIES[f"{_name}_clean"], SQL[f"{_name}_clean"] = _clean_of(_rows, _file)


def _packets(rows: list, parse: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        @F.pandas_udf("array<struct<key:string,value:string>>")
        def items(bodies: pd.Series) -> pd.Series:
            from ..formats import packets

            return bodies.map(lambda b: [{"key": k, "value": v} for k, v in getattr(packets, parse)(bytes(b))])

        df = spark.createDataFrame([(r[0], r[1]) for r in rows], "id long, body binary")
        got = df.select("id", F.posexplode(items("body")).alias("item_ord", "i"))
        return got.select("id", F.col("item_ord").cast("long").alias("item_ord"), "i.key", "i.value")

    flat = [(r[0], i, k, v) for r in rows for i, (k, v) in enumerate(r[2])]
    return run, f"WITH {X.Literal('x', 'id long, item_ord long, key string, value string', flat).cte()} SELECT * FROM x"


QUERIES["xmp_fields"], SQL["xmp_fields"] = _packets(X.XMP, "xmp_items")
QUERIES["iptc_fields"], SQL["iptc_fields"] = _packets(X.IPTC, "iptc_items")


@query(f"WITH {X.PPM.cte()}, l AS (SELECT id, unnest(list_filter(list_transform(string_split(body, chr(10)), lambda s: ltrim(s)), lambda s: starts_with(s, '#'))) AS value, generate_subscripts(list_filter(list_transform(string_split(body, chr(10)), lambda s: ltrim(s)), lambda s: starts_with(s, '#')), 1) AS n FROM lit_ppm) SELECT id, 'comment line ' || n AS key, value FROM l")
def ppm_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.PPM.df(spark).select("id", F.explode(T.ppm_comments(F.col("body"))).alias("c"))
    return c.select("id", F.concat(F.lit("comment line "), F.col("c.n").cast("string")).alias("key"), F.col("c.value").alias("value"))


@query(f"WITH {X.TAGS.cte()}, t AS (SELECT id, regexp_replace(CASE WHEN instr(line, ':') > 0 THEN substr(line, 1, instr(line, ':') - 1) ELSE line END, '^[\\s\"]+|[\\s\"]+$', '', 'g') AS key, regexp_replace(CASE WHEN instr(line, ':') > 0 THEN substr(line, instr(line, ':') + 1) ELSE '' END, '^[\\s\"]+|[\\s\",]+$', '', 'g') AS value FROM lit_tags) SELECT * FROM t WHERE key <> '' AND value <> ''")
def tag_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.TAGS.df(spark).select("id", T.tag_pair(F.col("line")).alias("p")).where("p is not null").select("id", "p.key", "p.value")


@query("SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def json_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", F.explode(F.map_entries(F.from_json("props", "map<string,string>"))).alias("e"))
    return e.select("event_id", "e.key", "e.value")


# ---- names and routing ----
def _case(column: str, pairs: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {X.sql_value(k)} THEN {X.sql_value(v)}" for k, v in pairs.items()) + f" ELSE {other} END"


_EXT = "lower(regexp_extract(regexp_extract({0}, '[^/\\\\]*$'), '^.+\\.([^.]*)$', 1))"
_URL_NAME = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '')"


@query(f"SELECT page_id, {_case(_EXT.format(_URL_NAME), MIME_OF, X.sql_value(OTHER))} AS mime_type FROM pages")
def mime_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/?#]*", ""), r"[?#].*$", "")
    return _table(spark, sf_dir, "pages").select("page_id", N.mime_type(path).alias("mime_type"))


@query(f"WITH {X.NAMES.cte()}, m AS (SELECT name, {_case(_EXT.format('name'), MIME_OF, X.sql_value(OTHER))} AS mime_type FROM lit_names) SELECT *, {_case('mime_type', HANDLER_OF, 'NULL')} AS handler FROM m")
def handler_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.NAMES.df(spark).withColumn("mime_type", N.mime_type(F.col("name"))).withColumn("handler", N.handler(F.col("mime_type")))


@query("SELECT unnest([" + ", ".join(X.sql_value(e) for e in SUPPORTED) + "]) AS extension")
def supported_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(e,) for e in SUPPORTED], "extension string")


@query("WITH " + X.Literal("x", "handler string, mime_type string", [(h, m) for h, ms in HANDLERS.items() for m in ms]).cte() + " SELECT handler, count(*)::BIGINT AS n FROM x GROUP BY handler")
def handler_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(m,) for m in HANDLER_OF], "mime_type string").select(N.handler(F.col("mime_type")).alias("handler")).groupBy("handler").agg(F.count(F.lit(1)).alias("n"))


def _archive_sql() -> str:
    from ..formats.fixed import ARCHIVE_SUFFIXES, PLAIN_SUFFIXES

    whens = [f"WHEN ends_with(lower(name), '{s}') THEN '{ARCHIVE_SUFFIXES[s]}'" for s in sorted(ARCHIVE_SUFFIXES, key=len, reverse=True)] + [f"WHEN ends_with(lower(name), '{s}') THEN 'plain {k}'" for s, k in PLAIN_SUFFIXES.items()]
    return f"WITH {X.NAMES.cte()} SELECT name, CASE {' '.join(whens)} ELSE 'unknown' END AS format FROM lit_names"


@query(_archive_sql())
def archive_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.NAMES.df(spark).withColumn("format", N.archive_format(F.col("name")))


@query(f"WITH {X.PATHS.cte()}, d AS (SELECT path, home, CASE WHEN instr(path, '/') > 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS d FROM lit_paths) SELECT path, CASE WHEN d = home THEN '~' WHEN starts_with(d, home || '/') THEN '~' || substr(d, length(home) + 1) ELSE d END AS directory FROM d")
def simplify_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.PATHS.df(spark).select("path", N.simplified_directory(F.col("path"), F.col("home")).alias("directory"))


@query(f"WITH {X.NAMES.cte()} SELECT name, list_contains(regexp_split_to_array(name, '[/\\\\]'), '..') AS traverses FROM lit_names")
def path_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.NAMES.df(spark).select("name", N.traverses(F.col("name")).alias("traverses"))


def _dangling(spark: SparkSession) -> DataFrame:
    rels = X.RELS.df(spark).withColumn("part", N.rels_target(F.col("rels_path"), F.col("target")))
    parts = X.PARTS.df(spark).withColumnRenamed("name", "part").withColumn("there", F.lit(True))
    keep = F.col("target").isNull() | (F.coalesce("mode", F.lit("")) == "External") | F.col("there").isNotNull()
    return rels.join(F.broadcast(parts), ["file_id", "part"], "left").withColumn("kept", keep)  # a literal table of three rows


_RELS = [(1, "media/a.png", "word/media/a.png", True), (1, "comments.xml", "word/comments.xml", False), (1, "/docProps/core.xml", "docProps/core.xml", True), (1, "../customXml/item1.xml", "customXml/item1.xml", False),
         (1, "http://x.example/", "word/http:/x.example", True), (1, "word/./x/../document.xml", "word/document.xml", True), (1, None, None, True), (2, "word/document.xml", "word/document.xml", False)]


@query(f"WITH {X.Literal('x', 'file_id long, target string, part string, kept boolean', _RELS).cte()} SELECT * FROM x")
def ooxml_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dangling(spark).select("file_id", "target", "part", "kept")


@query("SELECT doc_id, CASE WHEN n_chars >= 1024 THEN (n_chars // 1024) || ' KiB' ELSE n_chars || ' B' END AS size FROM documents")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", N.format_bytes(F.col("n_chars")).alias("size"))


@query(f"""WITH {X.BYTES.cte()}, t AS (SELECT n, CASE WHEN n >= 1073741824 THEN 1073741824 ELSE 1048576 END AS u FROM lit_bytes)
SELECT n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (n // 1024) || ' KiB' ELSE (n // u) || (CASE WHEN (n * 10 // u) % 10 = 0 THEN '' ELSE '.' || ((n * 10 // u) % 10) END) || (CASE WHEN u = 1048576 THEN ' MiB' ELSE ' GiB' END) END AS size FROM t""")
def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.BYTES.df(spark).withColumn("size", N.format_bytes(F.col("n")))


@query("SELECT doc_id, n_chars, n_chars > 4096 AS too_large FROM documents")
def size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "n_chars", N.over_cap(F.col("n_chars"), 4096).alias("too_large"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS path FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adding files: of equal canonical paths (here digests of texts) the first one gets a row."""
    from ..sources.scan import add_files

    d = _table(spark, sf_dir, "documents").where("text is not null")
    listed = d.select(F.sha2("text", 256).alias("canonical_path"), F.col("doc_id").alias("ord"), F.lit(0).alias("length"), F.lit(False).alias("is_link"))
    known = spark.createDataFrame([], "canonical_path string")
    return add_files(known, listed).select(F.col("ord").alias("doc_id"), F.col("canonical_path").alias("path"))


# ---- archives ----
def _tar(spark: SparkSession) -> DataFrame:
    return M.repeated(X.TAR.df(spark)).withColumn("refused", M.tar_refusal())


_TRAV = "list_contains(regexp_split_to_array({0}, '[/\\\\]'), '..')"


@query(f"""WITH {X.TAR.cte()}, s AS (SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY ord) > 1 AS seen FROM lit_tar)
SELECT file_id, ord, CASE WHEN starts_with(name, '/') THEN 'absolute path: ' || name WHEN {_TRAV.format('name')} THEN 'path traversal: ' || name WHEN seen THEN 'duplicate member: ' || name
  WHEN mode & 2048 <> 0 THEN 'setuid member: ' || name WHEN mode & 1024 <> 0 THEN 'setgid member: ' || name WHEN type IN ('char', 'block', 'fifo') THEN 'non-regular member: ' || name
  WHEN type = 'hardlink' THEN 'hardlink: ' || name WHEN type = 'symlink' AND (starts_with(link_target, '/') OR {_TRAV.format('link_target')}) THEN 'symlink escape: ' || name || ' -> ' || link_target END AS refused FROM s""")
def tar_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tar(spark).select("file_id", "ord", "refused")


@query(f"""WITH {X.TAR.cte()} SELECT file_id, ord, concat_ws(', ', CASE WHEN mtime <> 0 THEN 'mtime=' || mtime END, CASE WHEN uid <> 0 THEN 'uid=' || uid END, CASE WHEN gid <> 0 THEN 'gid=' || gid END,
  CASE WHEN uname <> '' THEN 'uname=' || uname END, CASE WHEN gname <> '' THEN 'gname=' || gname END) AS description FROM lit_tar""")
def tar_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.TAR.df(spark).select("file_id", "ord", M.tar_description().alias("description"))


@query(f"""WITH {X.ZIP.cte()}, d AS (SELECT file_id, ord, unix_mode IS NULL OR year <> 1980 OR comment <> '' AS suspicious, concat_ws(', ', CASE WHEN unix_mode & 3584 <> 0 THEN 'special bits 0o' || (unix_mode & 3584) // 512 || '000' END,
  CASE WHEN year <> 1980 THEN 'mtime ' || year || '-' || lpad(month::VARCHAR, 2, '0') || '-' || lpad(day::VARCHAR, 2, '0') END, CASE WHEN comment <> '' THEN 'comment "' || replace(replace(comment, '\\', '\\\\'), '"', '\\"') || '"' END) AS x FROM lit_zip)
SELECT file_id, ord, suspicious, CASE WHEN x = '' THEN 'normalized' ELSE x END AS description FROM d""")
def zip_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.ZIP.df(spark).select("file_id", "ord", M.is_suspicious_zip().alias("suspicious"), M.zip_description().alias("description"))


_NESTED = "'application/zip', 'application/zstd', 'application/gzip', 'application/x-bzip2', 'application/x-xz', 'application/x-tar'"


@query(f"""WITH {X.POLICY.cte()}, m AS (SELECT name, policy, {_case(_EXT.format('name'), MIME_OF, X.sql_value(OTHER))} AS mime FROM lit_policy),
h AS (SELECT *, {_case('mime', HANDLER_OF, 'NULL')} AS handler FROM m)
SELECT name, policy, CASE WHEN handler IS NOT NULL AND mime NOT IN ({_NESTED}) THEN 'clean' WHEN policy = 'keep' THEN 'write' WHEN policy = 'omit' THEN 'drop' ELSE 'error' END AS action FROM h""")
def member_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..formats.archive import NESTED

    m = X.POLICY.df(spark).withColumn("mime", N.mime_type(F.col("name")))
    m = m.withColumns({"nested": F.col("mime").isin(*sorted(NESTED)), "handled": N.handler(F.col("mime")).isNotNull()})
    return m.select("name", "policy", M.member_action(F.col("policy")).alias("action"))


@query(f"WITH {X.MEMBERS.cte()}, f AS (SELECT * FROM lit_members QUALIFY row_number() OVER (PARTITION BY file_id, name ORDER BY ord) = 1) SELECT file_id, ord, name, size, row_number() OVER (PARTITION BY file_id ORDER BY name <> 'mimetype', encode(name)) - 1 AS out_ord FROM f")
def member_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.output_order(X.MEMBERS.df(spark)).select("file_id", "ord", "name", "size", "out_ord")


@query(f"WITH {X.MEMBERS.cte()}, r AS (SELECT *, sum(size) OVER (PARTITION BY file_id ORDER BY ord)::BIGINT AS total FROM lit_members) SELECT file_id, ord, total, total > 1000 AS capped FROM r")
def cumulative_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.within_total_cap(X.MEMBERS.df(spark), 1000).select("file_id", "ord", "total", "capped")


@query("WITH " + X.KEYS.cte() + " SELECT key, " + " OR ".join(f"contains(lower(key), {X.sql_value(k)})" for k in T.STRUCTURAL_KEYS) + " AS structural FROM lit_keys")
def structural_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.KEYS.df(spark).select("key", T.is_structural_key(F.col("key")).alias("structural"))


# ---- the store ----
_STATE = {"signup": "Initializing", "view": "CheckingMetadata", "click": "HasMetadata", "purchase": "Cleaned", "error": "ErrorWhileCheckingMetadata"}


def _events(df: DataFrame) -> DataFrame:
    """The events table as lifecycle events; a timestamp and the event's number make up the sequence."""
    state = F.create_map(*[F.lit(x) for kv in _STATE.items() for x in kv])[F.col("event_type")]
    kind = F.when(F.col("event_type") == "error", "error").otherwise("state")
    return df.select(F.struct("ts", "event_id").alias("seq"), F.col("user_id").alias("file_id"), kind.alias("type"), state.alias("state"), F.lit(None).cast("long").alias("items"), F.when(F.col("event_type") == "error", F.col("props")).alias("message"))


_FOLD = f"""WITH e AS (SELECT user_id AS file_id, ts, event_id, {_case('event_type', _STATE, 'NULL')} AS state, CASE WHEN event_type = 'error' THEN props END AS message FROM events),
f AS (SELECT file_id, arg_max(state, (ts, event_id)) AS state, arg_max(message, (ts, event_id)) FILTER (message IS NOT NULL) AS error FROM e GROUP BY file_id)
"""
_SIMPLE = _case("state", S.SIMPLE, "NULL")
_IN = lambda xs: "(" + ", ".join(map(X.sql_value, xs)) + ")"


@query(_FOLD + "SELECT * FROM f")
def state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.fold_events(_events(_table(spark, sf_dir, "events"))).select("file_id", "state", "error")


@query(_FOLD + f"SELECT {_SIMPLE} AS simple_state, count(*)::BIGINT AS n FROM f GROUP BY ALL")
def state_simple_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_fold(spark, sf_dir).groupBy(S.simple_state(F.col("state")).alias("simple_state")).agg(F.count(F.lit(1)).alias("n"))


def _summary_sql(source: str) -> str:
    return f"""s AS (SELECT count(*)::BIGINT AS total, count(*) FILTER (state IN {_IN(S.CLEANABLE)})::BIGINT AS cleanable_count, count(*) FILTER (state = 'Cleaned')::BIGINT AS cleaned_count,
  coalesce(bool_or(state IN {_IN(S.WORKING)}), FALSE) AS has_working, count(*) FILTER (state NOT IN {_IN(S.WORKING)})::BIGINT AS done FROM {source})
SELECT *, CASE WHEN total = 0 THEN 0.0 ELSE done::DOUBLE / total END AS progress, CASE WHEN total = 0 THEN 'idle' WHEN done = total THEN 'done' ELSE 'working' END AS status,
  cleanable_count > 0 AND NOT has_working AS clean_enabled, cleaned_count || ' file(s) cleaned.' AS message FROM s"""


@query(_FOLD + ", " + _summary_sql("f"))
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.summary(state_fold(spark, sf_dir))


@query("WITH f AS (SELECT NULL::VARCHAR AS state WHERE FALSE), " + _summary_sql("f"))
def progress_of_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.summary(spark.createDataFrame([], "state string"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def stale_event_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of files (here customers with a balance) that are still in the store."""
    files = _table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("file_id"))
    e = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("file_id"))
    return store.drop_stale(e, files).select("event_id", F.col("file_id").alias("user_id"))


_AFTER = [(1, "Cleaned", 3, None), (2, "HasNoMetadata", 0, None), (3, "HasMetadata", 2, "bad file"), (4, "Unsupported", None, "no handler"), (5, "Initializing", None, None)]


@query(f"WITH {X.Literal('x', 'file_id long, state string, item_count long, error string', _AFTER).cte()} SELECT * FROM x")
def event_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal events: an error text outlives later events, an unknown id is dropped, a file without events stays."""
    files = spark.createDataFrame([(i, "Initializing") for i in range(1, 6)], "file_id long, state string")
    return store.apply_to(files, X.EVENTS.df(spark)).select("file_id", "state", "item_count", "error")


@query(_FOLD + "SELECT * FROM f")
def event_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold as a stream over the events files."""
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return fold.run_to_end(fold.fold_stream(_events(stream))).select("file_id", "state", "error")


@query(_FOLD + f"SELECT file_id, 'RemovingMetadata' AS state FROM f WHERE state IN {_IN(S.CLEANABLE)}")
def clean_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.to_clean(state_fold(spark, sf_dir)).select("file_id", "state")


# ---- containers built here, against literal tables of what they hold ----
def _bodies(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    df = spark.createDataFrame([(i, n, bytearray(b)) for i, (n, b) in enumerate(files)], "file_id long, filename string, body binary")
    return df.withColumn("mime_type", N.mime_type(F.col("filename")))


def _containers(spark: SparkSession) -> DataFrame:
    from .samples import CONTAINERS

    return _bodies(spark, [(n, b) for n, _, b in CONTAINERS()])


def _literal(schema: str, rows: list[tuple]) -> str:
    return f"WITH {X.Literal('x', schema, rows).cte()} SELECT * FROM x"


def _items(files: DataFrame) -> DataFrame:
    return ops.metadata_items(ops.process(files)).join(files.select("file_id", "filename"), "file_id").select("filename", "group_name", F.col("item_ord").cast("long").alias("item_ord"), "key", "value")


_ITEM_ROW = "filename string, group_name string, item_ord long, key string, value string"
_HEX = "filename string, body string, failed boolean"


def _hex(files: DataFrame) -> DataFrame:
    p = ops.process(files, read=False, clean=True)
    return p.select("filename", F.lower(F.hex("cleaned")).alias("body"), F.col("clean_error_class").isNotNull().alias("failed"))


@query(_literal(_ITEM_ROW, E.CONTAINER_ITEMS))
def container_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives and office files: headers of members, document properties, what members say of themselves."""
    return _items(_containers(spark).where(~F.col("filename").rlike(r"\.(pdf|flac|mp3)$")))


@query(_literal(_ITEM_ROW, E.PDF_ITEMS))
def pdf_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(_containers(spark).where("filename like '%.pdf'"))


@query(_literal(_ITEM_ROW, E.AUDIO_ITEMS))
def audio_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .samples import SOUNDS

    return _items(_bodies(spark, SOUNDS()))


@query(_literal(_ITEM_ROW, E.IMAGE_ITEMS))
def image_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .samples import IMAGES

    return _items(_bodies(spark, IMAGES()))


@query(_literal(_HEX, E.AUDIO_CLEAN))
def audio_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .samples import SOUNDS

    return _hex(_bodies(spark, SOUNDS()))


@query(_literal(_HEX, E.IMAGE_CLEAN))
def image_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .samples import IMAGES

    return _hex(_bodies(spark, IMAGES()))


@query(_literal(_ITEM_ROW, E.VIDEO_ITEMS))
def video_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .samples import VIDEOS

    return _items(_bodies(spark, VIDEOS()))


@query(_literal(_HEX, E.VIDEO_CLEAN))
def video_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .samples import VIDEOS

    return _hex(_bodies(spark, VIDEOS()))


@query(_literal(_ITEM_ROW, E.PLAIN_ITEMS))
def plain_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .samples import PLAIN

    return _items(_bodies(spark, PLAIN()))


@query(_literal(_HEX, E.PLAIN_CLEAN))
def plain_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .samples import PLAIN

    return _hex(_bodies(spark, PLAIN()))


@query(_literal("ord long, object string", E.PDF_OBJECTS))
def pdf_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of the cleaned PDF; what names them (offsets, identifier) follows from the bytes."""
    p = ops.process(_containers(spark).where("filename like '%.pdf'"), read=False, clean=True)
    body = F.decode("cleaned", "ISO-8859-1")
    found = F.regexp_extract_all(body, F.lit(r"(?s)\d+ 0 obj\n(.*?)\nendobj"), F.lit(1))
    return p.select(F.posexplode(found).alias("ord", "object")).select(F.col("ord").cast("long").alias("ord"), "object")


def _parts(files: DataFrame) -> DataFrame:
    """Members of cleaned containers, read by the standard library: (filename, ord, name, stamp, text)."""

    def run(batches):  # noqa: ANN001, ANN202
        import io
        import tarfile
        import zipfile

        import pyarrow as pa

        for b in batches:
            rows = []
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ".tar" in name:
                    with tarfile.open(fileobj=io.BytesIO(body)) as t:
                        rows += [(name, i, m.name, f"{m.mtime} {m.uid} {m.uname} {m.mode:o}", t.extractfile(m).read()) for i, m in enumerate(t)]
                else:
                    with zipfile.ZipFile(io.BytesIO(body)) as z:
                        rows += [(name, i, m.filename, f"{m.date_time[0]} {m.compress_type}", z.read(m)) for i, m in enumerate(z.infolist())]
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["filename", "ord", "name", "stamp", "body"])

    done = ops.process(files, read=False, clean=True).where("cleaned is not null").select("filename", "cleaned")
    got = done.mapInArrow(run, "filename string, ord long, name string, stamp string, body binary")
    text = F.regexp_replace(F.decode("body", "ISO-8859-1"), "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "UUID")
    return got.select("filename", "ord", "name", "stamp", text.alias("text"))


_PART = "filename string, ord long, name string, stamp string, text string"


@query(_literal(_PART, E.OFFICE_PARTS))
def office_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(_containers(spark).where(F.col("filename").rlike(r"\.(docx|odt|epub)$")))


@query(_literal(_PART, E.ARCHIVE_PARTS))
def archive_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(_containers(spark).where(F.col("filename").rlike(r"^a\.(zip|tar)"))).select("filename", "ord", "name", "stamp", "text")


@query(_literal("filename string, failed string", E.REFUSED))
def container_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which containers are refused, and why."""
    p = ops.process(_containers(spark), read=False, clean=True)
    return p.where("clean_error_class is not null").select("filename", F.col("clean_error_class").alias("failed"))


@query(_literal("filename string, ord long, name string, type string, mtime long, size long, error_class string", E.MEMBERS))
def container_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _containers(spark).where(N.handler(F.col("mime_type")) == "archive")
    got = ops.members(files).join(files.select("file_id", "filename"), "file_id")
    return got.select("filename", F.col("ord").cast("long").alias("ord"), "name", "type", "mtime", "size", "error_class")


@query(_FOLD + "SELECT * FROM f")
def event_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold with explicit per-file state, by time and event number; each file's last row is its state."""
    schema = _table(spark, sf_dir, "events").schema
    e = _events(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))
    e = e.withColumns({"tie": F.col("seq.event_id"), "seq": F.unix_micros(F.col("seq.ts").cast("timestamp"))})
    return fold.run_to_end(fold.fold_with_state(e), "update")


# ---- views of the store ----
@query(_FOLD + f"SELECT 'user-' || file_id || '.txt' AS filename, 'home/' || file_id % 7 AS directory, {_SIMPLE} AS simple_state, 0::BIGINT AS metadata_count FROM f")
def list_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of files as the view shows it."""
    f = store.fold_events(_events(_table(spark, sf_dir, "events")))
    path = F.concat(F.lit("home/"), (F.col("file_id") % 7).cast("string"), F.lit("/user-"), F.col("file_id").cast("string"), F.lit(".txt"))
    return store.list_rows(f.withColumns({"filename": N.file_name(path), "directory": N.directory(path)}))


@query("SELECT file_id, 'f' || file_id AS header, list(key || ': ' || value ORDER BY group_ord, item_ord) AS lines FROM (VALUES (1, 0, 0, 'Author', 'Al'), (1, 0, 1, 'Title', 'T'), (1, 1, 0, 'Author', 'Bo'), (2, 0, 0, 'k', '')) v(file_id, group_ord, item_ord, key, value) GROUP BY file_id")
def detail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the details of a file show: the first group's name and all items in order."""
    rows = [(1, 1, "inner", 0, "Author", "Bo"), (1, 0, "f1", 1, "Title", "T"), (2, 0, "f2", 0, "k", ""), (1, 0, "f1", 0, "Author", "Al")]
    items = spark.createDataFrame(rows, "file_id int, group_ord int, group_name string, item_ord int, key string, value string")
    return store.details(items)


_BAD = [
    (1, "Unsupported", "error", "UnsupportedFormat"), (2, "ErrorWhileCheckingMetadata", "error", "FileTooLarge"), (3, "ErrorWhileCheckingMetadata", "error", "ParseError"), (4, "HasNoMetadata", "warning", None),
]


@query(f"WITH {X.Literal('x', 'file_id long, state string, simple_state string, error_class string', _BAD).cte()} SELECT * FROM x")
def error_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no handler takes, that are too large, that are broken, and one that is fine."""
    rows = [(1, "a.bin", b"x"), (2, "big.css", b"a" * 100), (3, "bad.torrent", b"i-0e"), (4, "ok.css", b"a{}")]
    files = spark.createDataFrame(rows, "file_id long, filename string, body binary").withColumn("mime_type", N.mime_type(F.col("filename")))
    return ops.file_results(ops.process(files, Options(input_cap=64))).select("file_id", "state", "simple_state", "error_class")


@query("SELECT page_id, 'title' AS key, trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's')) AS value FROM pages")
def read_metadata_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function read_metadata over the pages' bodies, from SQL."""
    ops.register(spark)
    _table(spark, sf_dir, "pages").createOrReplaceTempView("loomsift_pages")
    return spark.sql("SELECT page_id, key, value FROM loomsift_pages, LATERAL read_metadata(CAST(html AS BINARY), 'page.html') WHERE key = 'title'")
