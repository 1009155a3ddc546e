"""A bitmap of 64-bit names for tasks to look up: its size does not grow with the data.

Names that were put in are always found; of the others some are found too, more
of them the more names were put in.  So it may spare work, never decide a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

BITS = 26  # 8 MB
SEGMENT = 1 << 14  # 64-bit words of the bitmap in one row


def _dense(pdf: pd.DataFrame) -> pd.DataFrame:
    words = np.zeros(SEGMENT, np.int64)
    words[pdf["word"].to_numpy() % SEGMENT] = pdf["bits"].to_numpy()
    return pd.DataFrame({"segment": [int(pdf["segment"].iat[0])], "words": [words.tobytes()]})


def bitmap(names: DataFrame, bits: int = BITS):
    """Broadcast bitmap of the column ``h`` of ``names``: ``2 ** bits`` bits, whatever their number.

    A name sets two bits, told by its upper and its lower end.
    """
    upper, lower = F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    places = names.select(F.explode(F.array(upper, lower)).alias("p"))
    set_bits = places.select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    words = set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words = words.withColumn("segment", F.floor(F.col("word") / SEGMENT).cast("int"))
    parts = words.groupBy("segment").applyInPandas(_dense, "segment int, words binary").collect()
    out = np.zeros((1 << bits) // 64, np.int64)
    for p in parts:
        out[p["segment"] * SEGMENT : (p["segment"] + 1) * SEGMENT] = np.frombuffer(p["words"], np.int64)
    return names.sparkSession.sparkContext.broadcast(out.view(A.U))


def marked(words: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of the names are in the bitmap."""
    bits = (64 * len(words)).bit_length() - 1

    def seen(place: np.ndarray) -> np.ndarray:
        return (words[(place >> A.U(6)).astype(np.int64)] >> (place & A.U(63)) & A.U(1)).astype(bool)

    found = seen(names >> A.U(64 - bits))
    found[found] = seen(names[found] & A.U((1 << bits) - 1))
    return found


def rows_of(df: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Rows of ``df`` whose key is among the distinct ``keys``: others are left out before any shuffle, as far as a bitmap tells.

    The join shuffles at every size: what is small on disk may be large in memory.
    """
    known = bitmap(keys.select(F.col(key).alias("h")))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(marked(known.value, batch.column(key).to_numpy().view(A.U))))

    return df.mapInArrow(run, df.schema).join(keys.hint("merge"), key)
