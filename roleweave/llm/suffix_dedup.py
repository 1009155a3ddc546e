"""Operator 1: exact substring dedup by prefix-free parsing.

Rolling-hash triggers cut the bytes of every text into overlapping phrases; the
counted phrase neighbourhoods are the dictionary, their sequence in each text
is the parse.  Where a classic prefix-free parse ranks dictionary and parse
suffixes to bring equal suffixes next to each other in corpus order, ranks are
replaced by names here (Karp, Miller and Rosenberg): the operator asks which
suffixes agree on their first ``length`` bytes, which needs equal names for
equal prefixes but no order among different ones, and names can be made by a
hash partition instead of a global sort.  A run of parse suffixes is named and
settled as a whole where it reads the same in two places; the suffixes of
phrases at the ends of repeats are named by their first ``length`` bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import query, table
from .parsing import Windows, repeated_windows


def remove_repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that starts more than once in all texts.

    Rows: id, n, n_removed, spans (byte ranges removed), kept (bytes left, null
    if unchanged), kept_sha256; one for each input row.

    Null texts count as empty.  A text shorter than ``length`` is unchanged.
    Places in one text and overlapping places count.  Repeated rows, also with
    one id or a null id, are texts of their own and repeat each other.  An
    empty table gives an empty result; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return repeated_windows(rows, Windows("bytes", length), ordered=False)


@query("op1_suffix_dedup")
def op1(spark, sf_dir):
    return remove_repeated_bytes(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_bytes"),
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256",
    )
