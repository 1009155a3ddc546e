"""Session set-up, scratch tables and the registry of this folder's queries."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roleweave.session import scratch_path, ship, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Whitespace of the word contracts: space, tab, newline, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def query(name: str, sql: str | None = None):
    """Register a query; its SQL twin, where there is one, runs on the same tables."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir.rstrip("/"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return wrap


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to Python workers; keep Arrow batches small, as texts can be long."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one job under ``spark.checkpoint.dir``.

    ``write`` cuts lineage: a lost executor costs a task, not the steps before.
    ``drop`` deletes a table once later ones no longer need it, and lets Spark
    clean up the shuffle files of finished steps.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, scratch_path(spark, name), 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:02d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(conf).delete(path, True)
        gc.collect()
        jvm.System.gc()


def row_key(*columns: str | Column) -> Column:
    """Key of a row by its content.  Equal rows share it; where two rows meet by chance, content is checked again."""
    return F.xxhash64(*columns)
