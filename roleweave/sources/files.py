"""Units, users, indices, runs and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed format: columns of the files that are read.
UNIT_TEXT = "user_id string, ids string, text string"
RESULTS = "iteration int, model string, log_prob double, rank double"
USER_SCORES = "row long, uid string, iden_id string, val double"
PRIORS = "user string, word string, epa string, total_sent double, n_tweets long"


def read_unit_text(spark: SparkSession, path: str) -> DataFrame:
    """user_id, ids (array), text."""
    raw = spark.read.schema(UNIT_TEXT).option("sep", "\t").option("quote", "\u0000").csv(path)
    return raw.select("user_id", F.split("ids", ",").alias("ids"), "text")


def read_json_units(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; compressed files are read as they are."""
    return spark.read.schema(schema).json(path)


def read_user_blocks(spark: SparkSession, path: str, names: tuple[str, str] = ("uid", "code")) -> DataFrame:
    """Whitespace separated pairs."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.get(parts, F.lit(0)).alias(names[0]), F.get(parts, F.lit(1)).alias(names[1]))


def read_runs(spark: SparkSession, path: str, schema: str = RESULTS) -> DataFrame:
    """All files of a folder and the folders in it, stacked, each tagged with its run number by full path."""
    reader = spark.read.schema(schema).option("sep", "\t").option("recursiveFileLookup", True)
    rows = reader.csv(path).withColumn("file", F.col("_metadata.file_path"))
    from ..operators.ranking import bucketed_row_number

    files = bucketed_row_number(rows.select("file").distinct(), [], ["file"], F.lit(0), "run")
    return rows.join(files, "file").drop("file")


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    """Tab separated report; arrays are comma-joined."""
    flat = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.option("sep", "\t").option("header", header).option("quote", "\u0000").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_index(index: DataFrame, path: str) -> None:
    """(idx, name) lines."""
    index.select("idx", "name").write.option("sep", "\t").csv(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("idx int, name string").option("sep", "\t").csv(path)


def write_units(units: DataFrame, path: str, mode: str = "append") -> None:
    """Units with at least one identity."""
    units.where(F.size("identities") > 0).write.mode(mode).parquet(path)


def read_units(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_users(units: DataFrame, path: str) -> None:
    """Units with ``user_id`` and ``split``, one folder per split."""
    units.write.partitionBy("split").parquet(path)


def read_users(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Stored users; columns that older files lack come as null."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    if columns is None:
        return df
    have = [F.col(c) if c in df.columns else F.lit(None).cast("array<string>").alias(c) for c in columns]
    return df.select(*have)


#: What tells one state of a file from another.
FILE_KEY = ["path", "size", "modified"]


def file_key() -> list[Column]:
    """Full path, size and time of the file that a row was read from."""
    m = F.col("_metadata")
    return [m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_modification_time"].alias("modified")]


def skip_done(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of input files that ``done`` (path, size, modified) does not list; a file that was changed counts as new."""
    named = inputs.select("*", *file_key())
    return named.join(done.select(*FILE_KEY).distinct(), FILE_KEY, "left_anti")
