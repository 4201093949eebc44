"""Session settings and tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Bounds of the Arrow batches that texts are handed to Python in, the same for every operator.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. In local mode (tests) a temporary one where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="loomsift-")
    return _OWN[app]


def materialize(df: DataFrame, label: str = "table", **measures: Column) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``measures`` are aggregates taken while writing; they come back as the attribute ``measured``.
    """
    path = f"{shared_dir(df.sparkSession)}/loomsift/{label}-{uuid.uuid4().hex}"
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    (df.observe(seen, *[m.alias(k) for k, m in measures.items()]) if measures else df).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomsift_path = path
    out.measured = seen.get if measures else {}
    return out


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_loomsift_path", None):
            remove(t.sparkSession, path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and by bytes. Every operator asks for the same, so the order of calls doesn't matter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
