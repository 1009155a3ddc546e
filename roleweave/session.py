"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "roleweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on (AQE does the sizing)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", **RUNTIME, **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Run-time settings the operators rely on.  Methods that HotSpot would not
# compile (over 8000 bytes), and rows of many fields, use split projections.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.codegen.maxFields": "40",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="roleweave-code-"), "roleweave_code")
        archive = shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session made elsewhere."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine; on a
    cluster an unset folder is an error, since executors could not read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="roleweave-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; never reused, so never overwritten."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts lineage in loops, survives executor loss, and gives the planner true
    file sizes, so that a small side is broadcast by Spark's own size check
    and a large one is not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write once to the shared folder, one file for each bucket of ``key``; joins on it leave the rows where they are."""
    spark = df.sparkSession
    buckets = max(buckets, 2 * spark.sparkContext.defaultParallelism)
    path = scratch_path(spark, name)
    table = os.path.basename(path).replace("-", "_")
    writer = df.repartition(buckets, key).write.format("parquet").option("path", path)
    writer.bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    out.scratch_path, out.scratch_table = path, table
    return out


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more; other frames are left alone."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path is None:
            continue
        spark = df.sparkSession
        if getattr(df, "scratch_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {df.scratch_table}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input that comes in fewer splits than there are cores.

    A table of many files is returned as it is, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
