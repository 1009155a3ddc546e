"""Corpus pipeline: quality rules, line dedup, near dedup, decontamination, mixing.

Each stage calls one operator of ``roleweave.llm`` and applies its decisions
to all rows that the stage before it kept.  All stages but the last return the
columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roleweave.llm import base, decontaminate, line_dedup, minhash, mixing, quality_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return base.table(base.prepare(spark), sf_dir.rstrip("/"), name)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    found = quality_rules.quality_rules(docs, _table(spark, sf_dir, "labels"))
    bad = found.filter("not kept").select(F.col("key").alias("_key")).distinct()
    keyed = docs.withColumn("_key", base.row_key("doc_id", "text"))
    return keyed.join(bad, "_key", "left_anti").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line blocks that an earlier one has; those of which no word is left go."""
    base.prepare(spark)
    out = line_dedup.remove_shared_lines(docs)
    changed = F.col("removed").isNotNull()
    gone = changed & ~F.col("kept_text").rlike(base.WORD)
    out = out.filter(~gone).withColumn("n_chars", F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("kept_text")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id and, within an id, of smallest row key."""
    base.prepare(spark)
    scratch = base.Scratch(spark, "near")
    groups = minhash.near_duplicate_groups(docs).filter("root is not null").select("root", "id", "key")
    groups = scratch.write(groups, "groups")
    first = groups.groupBy("root").agg(F.min(F.struct("id", "key")).alias("first"))
    gone = groups.join(first, "root").filter("key <> first.key").select(F.col("key").alias("_key")).distinct()
    keyed = docs.withColumn("_key", base.row_key("doc_id", "text"))
    kept = keyed.join(gone, "_key", "left_anti").select(docs.columns)
    return kept.dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item."""
    keyed = docs.withColumn("_key", base.row_key("doc_id", "text"))
    found = decontaminate.contaminated_words(keyed, _table(spark, sf_dir, "benchmark"), id_col="_key")
    bad = found.filter("contaminated").select(F.col("id").alias("_key")).distinct()
    return keyed.join(bad, "_key", "left_anti").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document in the mixture of sources."""
    base.prepare(spark)
    return mixing.realise(docs, mixing.mix_sources(docs))


STAGES = [
    ("quality rules", rules),
    ("line dedup", lines),
    ("near dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: The learned rules and the alignment cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    base.prepare(spark)
    scratch = base.Scratch(spark, "pipeline")
    docs = base.table(spark, sf_dir.rstrip("/"), "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
