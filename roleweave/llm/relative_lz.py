"""Operator 10: substring dedup against earlier texts, by names of windows.

The dealt method is relative Lempel-Ziv parsing; this is not one, as there are
no factors.  The neighbourhoods of content-defined anchors are indexed by the
ids that hold them, and the windows of words that only hold indexed ones are
settled in groups, or one by one at the ends of repeats (see ``parsing``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import query, table
from .parsing import Windows, repeated_windows


def remove_earlier_words(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word in a run of ``length`` words that also starts in a text with a smaller id.

    Rows: id, n (words), n_removed, spans (word ranges removed), kept (words
    left, joined by one space, as bytes; null if none was removed),
    kept_sha256 (of the words left, joined by one space); one for each input row.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Null texts have none.  Runs
    repeated within one text, or between rows of one id, stay.  A null id is
    neither smaller nor larger: its row is unchanged and removes nothing.  An
    empty table gives an empty result; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return repeated_windows(rows, Windows("words", length), ordered=True)


@query("op10_relative_lz")
def op10(spark, sf_dir):
    return remove_earlier_words(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_words"), "n_removed", "kept_sha256"
    )
