"""Operator 3: licence scan by canonical digests.

A text is brought to a canonical form: lower case, equivalent spellings made
equal, copyright lines and a licence's title at the start left out, punctuation,
comment marks and spacing made single spaces.
Digests of entire canonical texts are joined with those of known licences; so
is each line's, as notices of one line are licences' texts of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import query, row_key, table

# Public licence texts and notices, as commonly published.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Released under CC0 1.0"),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
]

#: Spellings that licence texts use for one another.
EQUAL = [("licence", "license"), ("licencing", "licensing"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"),
         ("organisation", "organization"), ("merchantability and fitness", "merchantability fitness"), ("copyright owner", "copyright holder")]
#: A line that starts with a copyright mark; a wrapped "copyright notice" or an item "(c)" is none.
NOT_COPYRIGHT = (
    r"(?m)^[^\p{L}\p{N}\n]*?(?:copyright\b(?![^\p{L}\p{N}]+(?:notices?|holders?|owners?|licen[cs]es?|laws?|statements?|interests?"
    r"|rights?|and|or|in|on|to|of|is|that|which)\b)|©|\(c\)[^\p{L}\p{N}\n]*(?:copyright\b|[0-9])|\(c\)[^\n]*[0-9]"
    r"|all rights reserved[^\p{L}\p{N}\n]*$)[^\n]*$"
)
#: The name of a licence as the first line with a word.
TITLE = (
    r"^[^\p{L}\p{N}]*(?:the )?(?:mit|expat|isc|(?:new |modified |simplified )?bsd(?: [23][- ]clause)?"
    r"(?: \"?(?:new|simplified)\"? or \"?(?:revised|freebsd)\"?)?) licen[cs]e(?: \((?:mit|expat|isc)\))?[^\p{L}\p{N}\n]*(?:\n|$)"
)


def canonical(text: Column) -> Column:
    """Canonical form, line by line: newlines stay."""
    t = F.lower(text)
    t = F.regexp_replace(F.regexp_replace(t, NOT_COPYRIGHT, ""), TITLE, "")
    for a, b in EQUAL:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")


def _digest(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, license) of each known text; equal texts of different names give the least name."""
    df = spark.createDataFrame(known, "license string, text string")
    return df.select(_digest(canonical(F.col("text"))).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences that each text is, or holds as a line.

    Rows: id, digest (of the whole canonical text), license (the known licence
    that the entire text is, else null), notices (sorted distinct licences that
    entire lines are), n_notices (such lines); one for each input row.

    Null texts count as empty; texts without a letter or digit have the digest
    of the empty string and match nothing.  A text that is one line is both.
    Repeated rows and null ids are answered each.  An empty table, or an empty
    list of licences, is no special case; further columns are ignored.

    ``known`` is joined by hash of the digest; the planner sends it to all
    tasks only where its measured size allows.
    """
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), canonical(F.coalesce(F.col(text_col), F.lit(""))).alias("c"))
    known = known.filter(F.col("digest") != F.sha2(F.lit(""), 256))
    lines = rows.select("key", F.explode(F.split("c", "\n")).alias("line")).select("key", _digest(F.col("line")).alias("digest"))
    found = lines.join(known, "digest").groupBy("key", "license").agg(F.count("*").alias("n"))
    found = found.groupBy("key").agg(F.array_sort(F.collect_list("license")).alias("notices"), F.sum("n").alias("n_notices"))
    whole = rows.select("id", "key", _digest(F.col("c")).alias("digest")).join(known, "digest", "left")
    return whole.join(found, "key", "left").select(
        "id", "digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"), F.coalesce("n_notices", F.lit(0)).alias("n_notices")
    )


@query("op3_license_scan")
def op3(spark, sf_dir):
    out = scan_licenses(table(spark, sf_dir, "documents"), known_licenses(spark))
    return out.select(F.col("id").alias("doc_id"), "digest", "license", F.concat_ws(",", "notices").alias("notices"), "n_notices")
