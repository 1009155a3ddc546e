"""Process only input files that were not processed before.

Two forms.  As a stream, the file source keeps the list of seen files in its
checkpoint.  As batches, a manifest of path, size and time is committed with the
output of each batch: data is written first, under the number of the batch, then
the manifest; what has no finished manifest does not count and is written anew.
Either way a re-run takes up new files only, and a lost executor, a crash or a
restart repeats no output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, exists, materialize
from ..sources.files import FILE_KEY, file_key


def process_new_files(
    spark: SparkSession, source: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], line_sep: str = "\n\n"
) -> None:
    """Apply a per-record transform to unseen text files, append parquet, stop; rows carry ``source_file``, the full path."""
    stream = spark.readStream.option("lineSep", line_sep).text(source)
    tagged = stream.withColumn("source_file", F.col("_metadata.file_path"))
    query = (
        transform(tagged).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


MANIFEST = "path string, size long, modified timestamp"


def _batches(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the batches whose manifest is complete, in order and without gaps."""
    n = 0
    while exists(spark, f"{out}/manifest/{n}/_SUCCESS"):
        n += 1
    return list(range(n))


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """Files that were taken, with their batch."""
    rows = spark.createDataFrame([], MANIFEST + ", batch int")
    paths = [f"{out}/manifest/{b}" for b in _batches(spark, out)]
    return spark.read.schema(MANIFEST + ", batch int").parquet(*paths) if paths else rows


def taken(spark: SparkSession, out: str) -> DataFrame | None:
    """Output of all complete batches; nothing of one that was cut short."""
    paths = [f"{out}/data/{b}" for b in _batches(spark, out)]
    return spark.read.parquet(*paths) if paths else None


def take_new_files(
    spark: SparkSession, source: str, out: str, transform: Callable[[DataFrame], DataFrame], line_sep: str = "\n\n"
) -> int:
    """Apply a per-record transform to the text files below ``source`` that no batch has taken; the number of files.

    A file counts by its full path, size and time, so files of equal name in two
    folders are two, and one that was changed is taken again.  Rows that the
    transform gets have ``value``, ``path``, ``size`` and ``modified``.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    listed = listed.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    new = materialize(listed.join(manifest(spark, out).select(*FILE_KEY), FILE_KEY, "left_anti"), "files")
    n = new.count()
    if n:
        batch = len(_batches(spark, out))
        lines = spark.read.option("lineSep", line_sep).option("recursiveFileLookup", True).text(source).select("value", *file_key())
        transform(lines.join(new, FILE_KEY, "left_semi")).write.mode("overwrite").parquet(f"{out}/data/{batch}")
        new.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/manifest/{batch}")
    discard(new)
    return n
