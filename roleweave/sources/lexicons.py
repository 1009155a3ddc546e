"""Lexicons, identity lists and equation tables from text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import DIMS, IDENTITY_PREFIX, SENTWORD_PREFIX, VALUE_OFFSET
from ..operators.ranking import stable_index


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # Quotes are ordinary characters in these files (emoticons hold them).
    return spark.read.schema(schema).option("sep", "\t").option("quote", "\u0000").csv(path)


def read_epa_lexicon(spark: SparkSession, path: str, offset: bool = True) -> DataFrame:
    """term, id, idx (null), e, p, a; ids do not depend on file order."""
    rows = _tsv(spark, path, "term string, e double, p double, a double")
    ids = stable_index(rows, "term", "id", SENTWORD_PREFIX)
    add = VALUE_OFFSET if offset else 0.0
    joined = rows.join(ids, "term")
    return joined.select("term", "id", F.lit(None).cast("int").alias("idx"), *[(F.col(d) + add).alias(d) for d in DIMS])


def read_identities(spark: SparkSession, path: str) -> DataFrame:
    """term, id, idx from trimmed lines."""
    lines = spark.read.text(path).select(F.trim("value").alias("term")).where(F.col("term") != "")
    ids = stable_index(lines, "term")
    idx = F.col("idx").cast("int")
    return ids.select("term", F.concat(F.lit(IDENTITY_PREFIX), idx.cast("string")).alias("id"), idx.alias("idx"))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Lower-case trimmed terms of one or many list files."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("term")).where(F.col("term") != "").distinct()


def read_valence_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "symbol string, value double")


def read_hashtag_epa(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "term string, e double, p double, a double")


def read_equation_table(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """(output, variables, coef): non-zero terms; the all-zero mask is the intercept."""
    parts = F.split("value", r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(
        F.split(F.regexp_replace(parts[0], "^Z", ""), "").alias("bits"),
        F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda c: c.cast("double")).alias("coefs"),
    )
    names = F.array(*[F.lit(v) for v in variables])
    used = F.filter(F.zip_with("bits", names, lambda b, v: F.when(b == "1", v)), lambda v: v.isNotNull())
    terms = rows.select(used.alias("variables"), F.posexplode("coefs").alias("output", "coef"))
    return terms.where(F.col("coef") != 0).select("output", "variables", "coef")


def read_equation_blocks(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """The second form: one block per output, lines ``coef`` or ``variables<TAB>coef``
    with two-letter variables.  Without ``order`` (an expression on ``_metadata`` and
    ``value``) blocks are numbered by their place in their file, files by path:
    a file is one record, so its splits do not matter."""
    if order is None:
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.split("value", "\n\n+").alias("_blocks"))
        blocks = whole.select("_file", F.posexplode(F.filter("_blocks", lambda b: F.trim(b) != "")).alias("_at", "value"))
        tagged = blocks.withColumn("output", (F.row_number().over(Window.orderBy("_file", "_at")) - 1).cast("long"))
    else:
        blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
        tagged = blocks.withColumn("output", F.expr(order))
    lines = tagged.select("output", F.explode(F.split("value", "\n")).alias("line")).where(F.trim("line") != "")
    parts = F.split(F.trim("line"), "\t")
    names = F.when(F.size(parts) > 1, F.regexp_extract_all(parts[0], F.lit("(..)"))).otherwise(F.array().cast("array<string>"))
    return lines.select("output", names.alias("variables"), F.element_at(parts, -1).cast("double").alias("coef"))


#: Generated columns of more terms would not compile.
MOST_TERMS = 2000


def equation_columns(terms: DataFrame, values: dict[str, Column]) -> list[Column]:
    """One sum of products per output.  The terms, a few dozen, are read to
    generate the columns; a table of over ``MOST_TERMS`` is refused."""
    outputs: dict[int, Column] = {}
    rows = terms.orderBy("output", F.array_join("variables", "")).take(MOST_TERMS + 1)
    if len(rows) > MOST_TERMS:
        raise ValueError(f"an equation table has at most {MOST_TERMS} terms")
    for row in rows:
        term = F.lit(row["coef"])
        for v in row["variables"]:
            term = term * values[v]
        out = row["output"]
        outputs[out] = outputs[out] + term if out in outputs else term
    return [outputs[k] for k in sorted(outputs)]
