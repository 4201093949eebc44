"""Reading and cleaning of files in bulk. One pass over the bodies serves both; failures are rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..options import Options

_ITEM = pa.struct([("key", pa.string()), ("value", pa.string())])
_GROUP = pa.struct([("filename", pa.string()), ("items", pa.list_(_ITEM))])
GROUPS = "array<struct<filename:string,items:array<struct<key:string,value:string>>>>"
_INPUT = ["file_id", "filename", "mime_type", "body"]
#: Bounds of the batches that bodies are handed over in, the same for all; a larger body comes alone.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _encode(groups: list | None) -> list | None:
    return None if groups is None else [{"filename": g, "items": [{"key": k, "value": v} for k, v in items]} for g, items in groups]


def _rows(b: pa.RecordBatch) -> Iterator[tuple[str, str, bytes | None]]:
    """(filename, mime_type, body) of a batch of _INPUT, one body at a time."""
    return ((n, m, x.as_py()) for n, m, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)))


def process(files: DataFrame, options: Options = Options(), read: bool = True, clean: bool = False) -> DataFrame:
    """(file_id, filename, groups, error_class, error, cleaned, clean_error_class, clean_error) of files with bodies."""
    _bounded(files.sparkSession)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        from ..formats.registry import clean_body, read_groups, safely

        nothing = (None, None, None)
        got, done = [], []
        for n, m, x in _rows(b):
            got.append(safely(read_groups, x, n, m, options) if read else nothing)
            done.append(safely(clean_body, x, n, m, options) if clean else nothing)
        cols = [b.column(0), b.column(1), pa.array([_encode(g[0]) for g in got], pa.list_(_GROUP)), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
        cols += [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["file_id", "filename", "groups", "error_class", "error", "cleaned", "clean_error_class", "clean_error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(one, batches)  # nothing of a batch is held while the next one is read

    kind = files.schema["file_id"].dataType.simpleString()
    schema = f"file_id {kind}, filename string, groups {GROUPS}, error_class string, error string, cleaned binary, clean_error_class string, clean_error string"
    return files.select(*_INPUT).mapInArrow(run, schema)


def recheck(files: DataFrame, options: Options = Options(), read: bool = True, clean: bool = True) -> DataFrame:
    """(file_id, filename, groups, same, error_class, error) after cleaning: what is left to read, and whether cleaning once more changes nothing.

    The worker that cleans a body also looks at it anew: a task has one Python process, and no table of bodies meets
    itself. What fails has null for both; a file without a body stays the same.
    """
    _bounded(files.sparkSession)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        from ..formats.registry import clean_body, read_groups, safely

        groups, same, errors = [], [], []
        for n, m, x in _rows(b):
            body, *error = safely(clean_body, x, n, m, options)
            got = again = None
            if body is not None and read:
                got, *error = safely(read_groups, body, n, m, options)
            if body is not None and clean:
                again, *failed = safely(clean_body, body, n, m, options)
                error = error if error[0] else failed
            groups.append(_encode(got))
            same.append(None if not clean or again is None and x is not None else again == body)
            errors.append(error)
        cols = [b.column(0), b.column(1), pa.array(groups, pa.list_(_GROUP)), pa.array(same, pa.bool_()), pa.array([e[0] for e in errors], pa.string()), pa.array([e[1] for e in errors], pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["file_id", "filename", "groups", "same", "error_class", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(one, batches)

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select(*_INPUT).mapInArrow(run, f"file_id {kind}, filename string, groups {GROUPS}, same boolean, error_class string, error string")


def metadata_items(processed: DataFrame) -> DataFrame:
    """(file_id, group_ord, group_name, item_ord, key, value), in file order; duplicates stay."""
    g = processed.select("file_id", F.posexplode("groups").alias("group_ord", "g"))
    return g.select("file_id", "group_ord", F.col("g.filename").alias("group_name"), F.posexplode("g.items").alias("item_ord", "i")).select(
        "file_id", "group_ord", "group_name", "item_ord", "i.key", "i.value"
    )


def file_results(processed: DataFrame) -> DataFrame:
    """(file_id, state, simple_state, item_count, error_class, error) after a check."""
    from ..functions.states import simple_state, total_count

    n = total_count(F.col("groups"))
    state = F.when(F.col("error_class") == "UnsupportedFormat", "Unsupported").when(F.col("error_class").isNotNull(), "ErrorWhileCheckingMetadata").when(n > 0, "HasMetadata").otherwise("HasNoMetadata")
    return processed.select("file_id", state.alias("state"), simple_state(state).alias("simple_state"), n.alias("item_count"), "error_class", "error")


def cleaned_files(processed: DataFrame) -> DataFrame:
    """(file_id, filename, body, action, error): action is write or error."""
    return processed.select("file_id", "filename", F.col("cleaned").alias("body"), F.when(F.col("clean_error_class").isNull(), "write").otherwise("error").alias("action"), F.col("clean_error").alias("error"))


MEMBERS = (
    "file_id {0}, ord int, name string, type string, mode int, uid long, gid long, mtime long, uname string, gname string, link_target string, comment string, compression string, "
    "year int, month int, day int, size long, body binary, error_class string, error string"
)


def members(files: DataFrame, options: Options = Options()) -> DataFrame:
    """A row for each member of each archive, bodies inflated; a refused archive gives one row with an error."""
    _bounded(files.sparkSession)
    kind = files.schema["file_id"].dataType.simpleString()
    schema = StructType.fromDDL(MEMBERS.format(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        from ..formats.archive import members as explode
        from ..formats.registry import safely

        target = to_arrow_schema(schema)
        for b in batches:
            for file_id, name, body in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
                got, error_class, error = safely(lambda x, n, m, o: explode(x, n, o), body, name, "", options)
                rows = [{**vars(m), "size": len(m.body) if m.body is not None else None, "error_class": None, "error": None} for m in got or []]
                if error_class:
                    rows = [dict.fromkeys(target.names) | {"error_class": error_class, "error": error}]
                yield pa.RecordBatch.from_pylist([r | {"file_id": file_id} for r in rows], schema=target)

    return files.select(*_INPUT).mapInArrow(run, schema)


def rebuild_zip(cleaned_members: DataFrame, options: Options = Options()) -> DataFrame:
    """(file_id, name, body) of cleaned members -> (file_id, body): ZIP files with members by name, mimetype first.

    The members of one file meet in one row, as its ZIP is one body anyway.
    """
    each = F.struct(F.col("name") != "mimetype", "name", "body")
    grouped = cleaned_members.groupBy("file_id").agg(F.sort_array(F.collect_list(each)).alias("m"))

    @F.pandas_udf("binary")
    def build(parts):  # noqa: ANN001, ANN202
        from ..formats.archive import build_zip

        return parts.map(lambda rows: build_zip([(r["name"], bytes(r["body"]), 0 if r["name"] == "mimetype" else 8) for r in rows]))

    return grouped.select("file_id", build(F.transform("m", lambda x: F.struct(x["name"].alias("name"), x["body"].alias("body")))).alias("body"))


def register(spark: SparkSession, options: Options = Options()) -> None:
    """SQL functions: read_metadata (a table function over body and file name), clean_metadata, mime_of and handler_of."""
    from pyspark.sql.functions import pandas_udf, udtf

    from ..formats.registry import HANDLER_OF, MIME_OF, OTHER

    @udtf(returnType="group_ord int, group_name string, item_ord int, key string, value string, error_class string, error string")
    class ReadMetadata:
        def eval(self, body: bytes, filename: str):  # noqa: ANN202
            from ..formats.registry import mime_of, read_groups, safely

            got, error_class, error = safely(read_groups, bytes(body) if body is not None else None, filename, mime_of(filename), options)
            if error_class:
                yield None, None, None, None, None, error_class, error
            for g, (name, items) in enumerate(got or []):
                for i, (k, v) in enumerate(items):
                    yield g, name, i, k, v, None, None

    @pandas_udf("binary")
    def clean(bodies: pd.Series, names: pd.Series) -> pd.Series:
        from ..formats.registry import clean_body, mime_of, safely

        return pd.Series([safely(clean_body, bytes(b) if b is not None else None, n, mime_of(n), options)[0] for b, n in zip(bodies, names)], dtype=object)

    spark.udtf.register("read_metadata", ReadMetadata)
    spark.udf.register("clean_metadata", clean)
    # these two are SQL, so they stay in the JVM; the doubled backslashes are SQL's
    ext = r"lower(regexp_extract(element_at(split(name, '[/\\\\]'), -1), '^.+\\.([^.]*)$', 1))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION mime_of(name STRING) RETURNS STRING RETURN coalesce(try_element_at({_sql_map(MIME_OF)}, {ext}), '{OTHER}')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION handler_of(mime STRING) RETURNS STRING RETURN try_element_at({_sql_map(HANDLER_OF)}, mime)")


def _sql_map(d: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{x}'" for kv in d.items() for x in kv) + ")"


def write_cleaned(cleaned: DataFrame, folder: str) -> DataFrame:
    """Write each cleaned body under ``folder`` by file_id and name -> (file_id, path, length).

    ``folder`` is a URI (file, hdfs, s3, gs, abfs) or a local path; on a cluster it has to be one that all machines see.
    A private file is written first and then moved over the name, so a reader finds the whole file or none, and a task
    that runs twice does no harm. Inputs are never touched. A column ``mode`` gives the permissions of local files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        from pyarrow import fs as store

        fs, root = store.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        local = isinstance(fs, store.LocalFileSystem)
        made = False
        for b in batches:
            rows = []
            for file_id, name, body, mode in zip(*(c.to_pylist() for c in b.columns)):
                if not made:
                    fs.create_dir(root, recursive=True)
                    made = True
                path = f"{root}/{file_id}-{os.path.basename(name)}"
                tmp = f"{path}.{uuid.uuid4().hex}.tmp"
                if local:
                    with open(os.open(tmp, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
                        f.write(body)
                        f.flush()
                        os.fchmod(f.fileno(), 0o644 if mode is None else mode & 0o777)
                        os.fsync(f.fileno())
                    os.replace(tmp, path)
                else:
                    with fs.open_output_stream(tmp, compression=None) as f:
                        f.write(body)
                    fs.move(tmp, path)
                rows.append((file_id, path, len(body)))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.types[0]), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["file_id", "path", "length"])

    _bounded(cleaned.sparkSession)
    kind = cleaned.schema["file_id"].dataType.simpleString()
    mode = F.col("mode").cast("int") if "mode" in cleaned.columns else F.lit(None).cast("int")
    rows = cleaned.where("action = 'write' and body is not null").select("file_id", "filename", "body", mode.alias("mode"))
    return rows.mapInArrow(run, f"file_id {kind}, path string, length long")
