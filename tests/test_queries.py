"""The engine's queries against their SQL, and its operators over small tables."""

import math
import os

import duckdb
import pytest

from pyspark.sql import functions as F

from loomsift.formats.registry import handler_of, mime_of
from loomsift.operators import files as ops
from loomsift.operators import store
from loomsift.options import Options
from loomsift.plans import fixtures as X
from loomsift.plans import queries as q
from loomsift.plans.samples import CONTAINERS
from loomsift.sources import scan
from loomsift.streaming import fold

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if r[i] is None or isinstance(r[i], float) and math.isnan(r[i]) else f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, con, name):
    df = q.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in q.SQL:
        assert got
        return
    cur = con.execute(q.SQL[name])
    want = cur.fetchall()
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, want)


@pytest.mark.parametrize("name", ["html_clean_idempotent", "html_read_after_clean"])
def test_cleaned_pages_are_looked_at_in_one_pass(spark, tmp_path, name):
    """A Python process a task and no join, so ids that are null or come twice, and pages without html, keep their rows."""
    pages = [(1, "<title>T</title><script>x</script>a"), (1, "<p onclick=x>b"), (None, "<!-- c -->d"), (2, None), (3, "")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    df = q.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(df.columns, c.execute(q.SQL[name]).fetchall())


def test_recheck_tells_what_cleaning_left(spark):
    """As two passes of process do; cleaning the second page shifts its quotes, so that a handler is left. The first error is told."""
    files = [(1, "a.html", "text/html", b"<title>T</title>"), (2, "b.html", "text/html", b"<p 'a onx=1' b>' onclick=z>"), (3, "n.html", "text/html", None), (4, "a.bin", "x/y", b"x"), (5, "c.torrent", "application/x-bittorrent", b"x")]
    df = spark.createDataFrame([(i, n, m, b and bytearray(b)) for i, n, m, b in files], "file_id long, filename string, mime_type string, body binary")
    got = {r.file_id: (r.groups, r.same, r.error_class) for r in ops.recheck(df).collect()}
    once = ops.process(df, read=False, clean=True)
    first = {r.file_id: r for r in once.collect()}
    twice = {r.file_id: r for r in ops.process(once.join(df.select("file_id", "mime_type"), "file_id").withColumn("body", F.col("cleaned")), clean=True).collect()}
    for i, (groups, same, error) in got.items():
        assert (groups, error) == (twice[i].groups, first[i].clean_error_class)
        assert same is (True if i == 3 else None if first[i].cleaned is None else first[i].cleaned == twice[i].cleaned)
    assert [got[i][1] for i in range(1, 6)] == [True, False, True, None, None]


def test_scan_follows_no_links(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.html").write_text("<title>T</title>")
    (tmp_path / ".hidden.txt").write_text("x")
    os.symlink(tmp_path / "sub" / "a.html", tmp_path / "link.html")
    listed = scan.list_directory(spark, str(tmp_path))
    assert sorted(os.path.basename(r.path) for r in listed.collect()) == [".hidden.txt", "a.html"]
    bodies = scan.read_bodies(listed)
    files = scan.routed(bodies, body=bodies["body"])
    items = ops.metadata_items(ops.process(files)).collect()
    assert [(r.key, r.value) for r in items] == [("title", "T")]
    assert scan.list_directory(spark, str(tmp_path / "none")).count() == 0


def test_sql_functions_and_rebuild(spark, tmp_path):
    ops.register(spark)
    spark.createDataFrame([(1, "a.html", bytearray(b"<title>T</title>")), (2, "a.bin", bytearray(b"x")), (3, "n.html", None)], "id int, name string, body binary").createOrReplaceTempView("t")
    got = spark.sql("select id, key, value, error_class from t, lateral read_metadata(body, name)").collect()
    assert sorted((r.id, r.key, r.error_class) for r in got if r.id != 3) == [(1, "title", None), (2, None, "UnsupportedFormat")]
    assert spark.sql("select clean_metadata(body, name) c from t where id = 1").first().c == b"<title></title>"
    files = spark.createDataFrame([(i, n, m, bytearray(b)) for i, (n, m, b) in enumerate(CONTAINERS())], "file_id long, filename string, mime_type string, body binary")
    m = ops.members(files.where("filename = 'a.zip'")).where("body is not null")
    assert ops.rebuild_zip(m.select("file_id", "name", "body")).count() == 1
    done = ops.cleaned_files(ops.process(files, read=False, clean=True))
    written = ops.write_cleaned(done, str(tmp_path / "out")).collect()
    assert len(written) == done.where("action = 'write'").count() == len(os.listdir(tmp_path / "out"))


def test_adding_paths(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc")
    (tmp_path / "big.txt").write_text("x" * 50)
    os.symlink(tmp_path / "a.txt", tmp_path / "link.txt")
    paths = scan.path_list(spark, "\0".join([f"{tmp_path}/a.txt", f"{tmp_path}/../{tmp_path.name}/a.txt", f"{tmp_path}/link.txt", f"{tmp_path}/big.txt", f"{tmp_path}/none", str(tmp_path), ""]))
    got = scan.add_files(spark.createDataFrame([(f"{os.path.realpath(tmp_path)}/none2",)], "canonical_path string"), scan.canonical(paths), Options(input_cap=10))
    by = {os.path.basename(r.path): (r.state, r.error) for r in got.collect()}
    assert len(by) == 5 and by["a.txt"] == ("Initializing", None) and by["link.txt"] == ("ErrorWhileInitializing", "symbolic links are not followed")
    assert by["big.txt"][1] == "50 bytes, the limit is 10" and by["none"][0] == "ErrorWhileInitializing" and by[tmp_path.name][1] == "no regular file"
    again = scan.add_files(got.select("canonical_path"), scan.canonical(paths))
    assert again.count() == 0


def test_deep_trees_are_listed_by_level(spark, tmp_path):
    deep = tmp_path
    for i in range(6):
        deep = deep / f"d{i}"
        deep.mkdir()
        (deep / f"f{i}.txt").write_text("x")
    os.symlink(tmp_path, deep / "loop")
    assert sorted(os.path.basename(r.path) for r in scan.list_directory(spark, str(tmp_path)).collect()) == [f"f{i}.txt" for i in range(6)]
    assert scan.list_directory(spark, str(tmp_path), recursive=False).count() == 0


def test_written_files_keep_their_mode(spark, tmp_path):
    rows = [(1, "a.txt", bytearray(b"x"), "write", 0o640), (2, "b.txt", bytearray(b"y"), "write", None), (3, "c.txt", None, "error", None)]
    df = spark.createDataFrame(rows, "file_id long, filename string, body binary, action string, mode int")
    for folder in (str(tmp_path / "o"), f"file://{tmp_path}/p"):
        got = {r.file_id: r for r in ops.write_cleaned(df, folder).collect()}
        assert sorted(got) == [1, 2] and [os.stat(got[i].path).st_mode & 0o777 for i in (1, 2)] == [0o640, 0o644] and sorted(os.listdir(os.path.dirname(got[1].path))) == ["1-a.txt", "2-b.txt"]


def test_sql_names(spark):
    ops.register(spark)
    names = [x for (x,) in X.NAMES.rows]
    spark.createDataFrame([(x,) for x in names], "name string").createOrReplaceTempView("n")
    got = {r.name: (r.m, r.h) for r in spark.sql("select name, mime_of(name) m, handler_of(mime_of(name)) h from n").collect()}
    assert got == {x: (mime_of(x), handler_of(mime_of(x))) for x in names}


def test_store_views(spark):
    s = spark.createDataFrame([(5, "Cleaned"), (2, "HasMetadata"), (9, "HasMetadata")], "file_id long, state string")
    assert [store.position(s, i).collect() for i in (2, 9, 7)] == [[(0,)], [(2,)], []] and store.clear(s).count() == 0


def test_folds_over_many_batches(spark, tmp_path):
    """A file an event: what no later batch touches stays in the result, and late events don't win."""
    rows = [(3, 0, 1, "state", "Cleaned", None, None), (1, 0, 1, "state", "CheckingMetadata", None, None), (2, 0, 2, "error", "Unsupported", None, "bad"), (3, 1, 2, "ready", None, 4, None), (3, 0, 2, "error", "Unsupported", None, "worse"), (9, 0, 3, "ready", None, 0, None)]
    schema = "seq long, tie long, file_id long, type string, state string, items long, message string"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        for f in (tmp_path / "e").glob("part-*"):
            if os.path.getmtime(f) > 10_000_000:
                os.utime(f, (1000 + i, 1000 + i))
    want = [(1, "Cleaned", None), (2, "HasMetadata", "worse"), (3, "HasNoMetadata", None)]

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))

    assert sorted(map(tuple, fold.run_to_end(fold.fold_with_state(stream()), "update").collect())) == want
    ordered = stream().withColumn("seq", F.struct("seq", "tie"))
    for mode in ("complete", "update"):
        assert sorted(map(tuple, fold.run_to_end(fold.fold_stream(ordered), mode).select("file_id", "state", "error").collect())) == want
    none = spark.readStream.schema(schema).parquet(str(tmp_path / "e") + "/nothing*")
    assert fold.run_to_end(fold.fold_with_state(none), "update").count() == 0
