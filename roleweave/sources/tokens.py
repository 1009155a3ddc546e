"""Token blocks: parsed units as text, blank line between units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed format: the fourteen tab fields of a token line, in order.
FIELDS = [
    "id", "form", "lemma", "cpos", "pos", "feats", "head", "_7", "_8", "_9", "unit_id", "user_id", "date", "label",
]
PTB_KEY = "penn_treebank_pos="


def _parsed(lines: Column) -> dict[str, Column]:
    parts = F.split(lines, "\t")
    cols = {name: F.get(parts, F.lit(i)) for i, name in enumerate(FIELDS) if not name.startswith("_")}
    for name, kind in (("id", "int"), ("head", "int"), ("unit_id", "long"), ("user_id", "long")):
        cols[name] = cols[name].try_cast(kind)
    cols["ptb"] = F.nullif(F.regexp_extract(cols["feats"], PTB_KEY + r"([^|]*)", 1), F.lit(""))
    return cols


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row per token of blank-line separated blocks.

    Blocks are read as records, so a unit is never cut by a file split.  Lines
    that do not have fourteen fields come with null columns; see
    `failed_units`.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path)
    lines = blocks.select(F.explode(F.split("value", "\n")).alias("line")).where(F.trim("line") != "")
    bad = F.size(F.split("line", "\t")) != len(FIELDS)
    cols = _parsed(F.col("line"))
    return lines.select(*[c.alias(n) for n, c in cols.items()], bad.alias("malformed"))


def failed_units(tokens: DataFrame) -> DataFrame:
    """(unit_id, n): units with lines that could not be read, counted."""
    return tokens.where("malformed").groupBy("unit_id").agg(F.count("*").alias("n"))


def _line(value: Callable[[str], Column], names: list[str]) -> Column:
    """Token line from the columns that there are."""
    values = {n: value(n).cast("string") if n in names else F.lit("_") for n in FIELDS}
    values["cpos"] = value("pos")
    values["feats"] = F.concat(F.lit(PTB_KEY), value("ptb"))
    return F.concat_ws("\t", *[values[n] for n in FIELDS])


def _write_lines(units: DataFrame, lines: Column, path: str, compression: str = "none") -> None:
    block = F.array_join(F.transform(F.sort_array(lines), lambda t: t["line"]), "\n")
    units.select(block.alias("value")).write.option("lineSep", "\n\n").option("compression", compression).text(path)


def write_token_blocks(tokens: DataFrame, path: str) -> None:
    """Tokens (with ptb and label) as blocks; one unit is one record."""
    line = _line(F.col, tokens.columns)
    _write_lines(tokens.groupBy("unit_id").agg(F.collect_list(F.struct("id", line.alias("line"))).alias("lines")), F.col("lines"), path)


def write_unit_blocks(units: DataFrame, path: str, compression: str = "gzip") -> None:
    """The same of units that have their tokens as ``nodes`` in their row: nothing is shuffled; files are compressed, readers take them as they are."""
    names = ["unit_id", *units.schema["nodes"].dataType.elementType.names]
    value = lambda n: lambda c: F.col(c) if c == "unit_id" else n[c]
    lines = F.transform("nodes", lambda n: F.struct(n["id"].alias("id"), _line(value(n), names).alias("line")))
    _write_lines(units, lines, path, compression)
