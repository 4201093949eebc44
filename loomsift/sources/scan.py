"""Files as rows: directory scans, explicit paths, tables that hold bodies."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import directory, file_name, handler, mime_type
from ..options import Options

LISTED = "path string, length long, mtime double"


def _entries(folder: str) -> Iterator[tuple[str, bool, int | None, float | None]]:
    """(path, is it a folder, length, mtime) of what lies in a folder, hidden files too.

    Links are not followed and give no row; what can't be read is left out.
    """
    try:
        with os.scandir(folder) as found:
            for e in found:
                try:
                    if e.is_dir(follow_symlinks=False):
                        yield e.path, True, None, None
                    elif e.is_file(follow_symlinks=False):
                        s = e.stat(follow_symlinks=False)
                        yield e.path, False, s.st_size, s.st_mtime
                except OSError:
                    continue
    except OSError:
        return


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for folder in b["path"]:
            rows: list[tuple] = []
            for row in _entries(folder):
                rows.append(row)
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=["path", "folder", "length", "mtime"])
                    rows = []
            yield pd.DataFrame(rows, columns=["path", "folder", "length", "mtime"]).astype({"length": "Int64"})


def list_directory(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, length, mtime) of a folder that all machines see, without reading a body.

    Level by level: tasks list the folders of a level, each by itself, and the folders they find are dealt anew for the
    next one, so that deep and lopsided trees are spread too. The driver sees counts only; a lost level is listed again.
    """
    level = spark.createDataFrame([(path,)], "path string")
    out = None
    while True:
        seen = level.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(_scan, "path string, folder boolean, length long, mtime double").persist()
        files = seen.where("not folder").select("path", "length", "mtime")
        out = files if out is None else out.unionByName(files)
        level = seen.where("folder").select("path")
        if not recursive or level.isEmpty():
            return out


def list_store(spark: SparkSession, path: str, recursive: bool = True, cap: int | None = None) -> DataFrame:
    """(path, length, modificationTime) of any store that Spark reads; the cap is pushed into the listing.

    As Spark lists it: names that begin with a dot or an underscore are left out, and on a local disk links are followed.
    Where neither will do, list with :func:`list_directory`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    files = files.select("path", "length", "modificationTime")
    return files if cap is None else files.where(F.col("length") <= cap)


def with_bodies(spark: SparkSession, path: str, cap: int | None = Options().input_cap) -> DataFrame:
    """binaryFile rows with their bodies, for any store; larger files than the cap are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return routed(files.where(F.col("length") <= cap) if cap is not None else files, body=F.col("content"))


def read_bodies(listed: DataFrame) -> DataFrame:
    """Adds ``body`` and ``read_error`` to listed local paths, read by the tasks."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in listed.schema)}, body binary, read_error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(len(b)):
                row = b.iloc[[i]].copy()
                try:
                    with open(row["path"].iloc[0], "rb") as f:
                        row["body"], row["read_error"] = [f.read()], [None]
                except OSError as e:
                    row["body"], row["read_error"] = [None], [e.strerror]
                yield row

    return listed.mapInPandas(run, schema)


def routed(files: DataFrame, path: str = "path", body: Column | None = None) -> DataFrame:
    """(file_id, path, filename, directory, mime_type, handler, length[, body]) of rows with a path column."""
    p = F.col(path)
    mime = mime_type(p)
    cols = [F.xxhash64(p).alias("file_id"), p.alias("path"), file_name(p).alias("filename"), directory(p).alias("directory"), mime.alias("mime_type"), handler(mime).alias("handler")]
    if body is None:
        return files.select(*cols, *(["length"] if "length" in files.columns else []))
    return files.select(*cols, F.octet_length(body).cast("long").alias("length"), body.cast("binary").alias("body"))


def canonical(paths: DataFrame) -> DataFrame:
    """(path, ord) -> with canonical_path, length, is_link and error, found by the tasks: for :func:`add_files`.

    A link keeps its own place as its canonical path, as it isn't followed.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in paths.schema)}, canonical_path string, length long, is_link boolean, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import stat

        for b in batches:
            rows = []
            for p in b["path"]:
                home, name = os.path.split(os.path.abspath(p))
                try:
                    s = os.lstat(p)
                    link = stat.S_ISLNK(s.st_mode)
                    rows.append((os.path.join(os.path.realpath(home), name), s.st_size, link, None if link or stat.S_ISREG(s.st_mode) else "no regular file"))
                except (OSError, ValueError) as e:
                    rows.append((os.path.join(os.path.realpath(home), name), None, False, getattr(e, "strerror", None) or str(e)))
            yield b.assign(**{c: list(v) for c, v in zip(("canonical_path", "length", "is_link", "error"), zip(*rows))}).astype({"length": "Int64"}) if rows else pd.DataFrame(columns=[f.split()[0] for f in schema.split(", ")])

    return paths.mapInPandas(run, schema)


def path_list(spark: SparkSession, joined: str, separator: str = "\0") -> DataFrame:
    """(path, ord) of paths joined by NUL, as a file chooser hands them over; empty ones are left out."""
    rows = spark.createDataFrame([(joined,)], "joined string").select(F.posexplode(F.split("joined", separator)).alias("ord", "path"))
    return rows.where("path <> ''").select("path", F.col("ord").cast("long").alias("ord"))


def add_files(known: DataFrame, listed: DataFrame, options: Options = Options()) -> DataFrame:
    """New rows of ``listed`` (canonical_path, ord, length, is_link[, error]): duplicates of known or earlier paths get no row.

    Links, files over the cap and those that came with an error get a row with state ErrorWhileInitializing and the error.
    """
    given = F.col("error") if "error" in listed.columns else F.lit(None).cast("string")
    bad = F.when(F.col("is_link"), "symbolic links are not followed").when(given.isNotNull(), given)
    if options.input_cap is not None:
        bad = bad.when(F.col("length") > options.input_cap, F.format_string(f"%d bytes, the limit is {options.input_cap}", "length"))
    first = listed.groupBy("canonical_path").agg(F.min_by(F.struct(*[c for c in listed.columns if c != "canonical_path"]), "ord").alias("r")).select("canonical_path", "r.*")
    new = first.join(known.select("canonical_path").distinct(), "canonical_path", "left_anti")
    return new.withColumn("error", bad).withColumn("state", F.when(F.col("error").isNull(), "Initializing").otherwise("ErrorWhileInitializing"))
