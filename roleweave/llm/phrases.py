"""Operator 11: phrase collocation mining by Rabin-Karp fingerprints.

Prefix sums of two polynomials over the bytes of a text give the fingerprint of
every n-gram as a difference of two places.  A task counts the n-grams of a
batch by fingerprint, and a shuffle adds the counts up, each with a pointer: the
key of a text that holds the n-gram.  Only for fingerprints counted often
enough the pointer is followed, the text is hashed again, and the words are
read off.  Two n-grams that meet in the first fingerprint are told apart by the
second, whose bytes and base are others, and both are looked up in their texts;
after that counts belong to words, not to fingerprints.

An n-gram is as frequent as its two (n-1)-grams at least, so longer ones are
counted only where both of these may be frequent.  That is read off a bitmap of
the frequent fingerprints.  Its size does not grow with the data, and it lets too
much through, never too little: counts stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from .base import Scratch, query, row_key, table
from .bits import bitmap, marked

#: Kinds of bytes: 0 for the gaps between words, 1 for words; the marks end a piece.
KIND = np.ones(256, np.uint8)
KIND[[0x20, 0x09]] = 0
MARK = np.zeros(256, bool)
MARK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
KIND[MARK] = 0


class Grams:
    """Words of some texts and the fingerprints of all n-grams inside their pieces."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray):
        base = offsets[0]
        self.data, offsets = A.LOWER[data[base : offsets[-1]]], offsets - base
        inside = KIND[self.data].view(bool)
        edge = np.zeros(len(self.data) + 1, bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        marks = np.concatenate(([0], np.cumsum(MARK[self.data])))
        self.piece = marks[self.start] + self.text
        # words one space apart, whatever was between them
        keep = inside.copy()
        keep[1:] |= last[:-1] & ~inside[1:]
        line = np.where(inside, self.data, 0x20)[keep]
        where = np.concatenate(([0], np.cumsum(keep)))
        self.begins, self.ends = where[self.start], where[self.end]
        self.runs = [A.RunHash(TABLES[i][line], b) for i, b in enumerate(A.BASES)]
        self.seeds = seeds

    def whole(self, n: int) -> np.ndarray:
        """First word of every n words in a row inside a piece."""
        at = np.arange(max(len(self.start) - n + 1, 0))
        return at[self.piece[at] == self.piece[at + n - 1]]

    def names(self, at: np.ndarray, n: int, which: int) -> np.ndarray:
        """Fingerprints of the n words from each place on, with the group of the text."""
        return A.mix(self.runs[which](self.begins[at], self.ends[at + n - 1]) + self.seeds[self.text[at]])

    def words(self, at: int, n: int) -> str:
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(at, at + n)).decode()


#: A random value for each byte and polynomial.
TABLES = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * A.U(2) + A.U(1)


def _seeds(batch: pa.RecordBatch) -> np.ndarray:
    """One value for each group, spread over 64 bits."""
    return A.mix(batch.column("seed").to_numpy().view(A.U).copy())


def _frequent(grams: Grams, n: int, filters) -> np.ndarray:
    """First words of the n-grams whose parts may all be frequent, as far as filters (by length, from 2) go."""
    at = grams.whole(n)
    for length, words in enumerate(filters, 2):
        for shift in range(n - length + 1):
            at = at[marked(words.value, grams.names(at + shift, length, 0))]
    return at


def _grouped(h: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal rows together, and where each group begins."""
    order = np.argsort(h)
    change = np.ones(len(h), bool)
    change[1:] = h[order][1:] != h[order][:-1]
    for x in more:
        change[1:] |= x[order][1:] != x[order][:-1]
    return order, np.flatnonzero(change)


def _counted(n: int, filters):
    """(h, c): n-grams of a batch by their first fingerprint, to find the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.utf8(batch.column("text"))
            seeds, found = _seeds(batch), []
            for lo, hi in A.slices(offsets, 4 * A.SLICE):
                grams = Grams(data, offsets[lo : hi + 1], seeds[lo:hi])
                found.append(grams.names(_frequent(grams, n, filters), n, 0))
            h = np.concatenate(found) if found else np.zeros(0, A.U)
            order, begin = _grouped(h)
            yield pa.RecordBatch.from_arrays([A.longs(h[order][begin]), A.longs(np.diff(np.append(begin, len(h))))], names=["h", "c"])

    return run


def _pointed(longest: int, filters):
    """(h, k, c, key): n-grams of a batch by both fingerprints, each with the key of a text that holds it; the empty one counts all words."""

    def run(batches):
        for batch in batches:
            data, offsets = A.utf8(batch.column("text"))
            keys, seeds = batch.column("key").to_numpy(), _seeds(batch)
            found: list[list[np.ndarray]] = [[np.zeros(0, A.U)], [np.zeros(0, A.U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            for lo, hi in A.slices(offsets, 4 * A.SLICE):
                grams = Grams(data, offsets[lo : hi + 1], seeds[lo:hi])
                for n in range(1, longest + 1):
                    at = _frequent(grams, n, filters[: n - 1])
                    for i in (0, 1):
                        found[i].append(grams.names(at, n, i))
                    found[2].append(keys[lo + grams.text[at]])
                    found[3].append(np.ones(len(at), np.int64))
                found[0].append(seeds[lo:hi])
                found[1].append(seeds[lo:hi])
                found[2].append(keys[lo:hi])
                found[3].append(np.bincount(grams.text, minlength=hi - lo))
            h, k, key, c = map(np.concatenate, found)
            if not len(h):
                continue
            order, begin = _grouped(h, k)
            sums, least = np.add.reduceat(c[order], begin), np.minimum.reduceat(key[order], begin)
            yield pa.RecordBatch.from_arrays(
                [A.longs(h[order][begin]), A.longs(k[order][begin]), A.longs(sums), A.longs(least)], names=["h", "k", "c", "key"]
            )

    return run


def _read(longest: int):
    """The words that the pointers into a text stand for."""

    def run(batches):
        for batch in batches:
            data, offsets = A.utf8(batch.column("text"))
            asked, seeds = A.Lists(batch.column("asked")), _seeds(batch)
            out: dict[str, list] = {"lang": [], "n": [], "phrase": [], "c": []}
            langs = batch.column("lang").to_pylist()
            for r in range(len(batch)):
                wanted = asked.fields(r)
                rows = {(int(h), int(k)): int(c) for h, k, c in zip(wanted["h"].view(A.U), wanted["k"].view(A.U), wanted["c"])}
                names = np.sort(wanted["h"].view(A.U))
                grams = Grams(data, offsets[r : r + 2], seeds[r : r + 1])
                empty = rows.pop((int(seeds[r]), int(seeds[r])), None)
                if empty is not None:
                    out["lang"].append(langs[r]), out["n"].append(0), out["phrase"].append(""), out["c"].append(empty)
                for n in range(1, longest + 1):
                    at = grams.whole(n)
                    h = grams.names(at, n, 0)
                    place = np.minimum(np.searchsorted(names, h), len(names) - 1)
                    at, h = at[names[place] == h], h[names[place] == h]
                    k = grams.names(at, n, 1)
                    for i, pair in enumerate(zip(h.tolist(), k.tolist())):
                        c = rows.pop(pair, None)
                        if c is not None:
                            out["lang"].append(langs[r]), out["n"].append(n), out["phrase"].append(grams.words(at[i], n)), out["c"].append(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["lang"], pa.string()), pa.array(out["n"], pa.int32()), pa.array(out["phrase"], pa.string()), pa.array(out["c"], pa.int64())],
                names=list(out),
            )

    return run


def phrase_counts(
    docs: DataFrame, scratch: Scratch, longest: int = 3, least: int = 10, group_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, n, phrase, c): all phrases of up to ``longest`` words that occur ``least`` times or more in the texts of a group.

    The phrase of no words, n = 0, counts all words of the group.  A null group is ``und``; null texts are empty.
    """
    docs = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("seed", F.xxhash64("lang")).withColumn("key", row_key("lang", "text"))
    filters: list = []
    for n in range(2, longest):
        counted = docs.select("text", "seed").mapInArrow(_counted(n, filters), "h long, c long")
        frequent = scratch.write(counted.groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= least).select("h"), f"frequent{n}")
        filters.append(bitmap(frequent))
        scratch.drop(frequent)
    pointed = docs.select("text", "seed", "key").mapInArrow(_pointed(longest, filters), "h long, k long, c long, key long")
    pointed = pointed.groupBy("h", "k").agg(F.sum("c").alias("c"), F.min("key").alias("key")).filter(F.col("c") >= least)
    pointed = scratch.write(pointed, "pointed")
    asked = scratch.write(pointed.groupBy("key").agg(F.collect_list(F.struct("h", "k", "c")).alias("asked")), "asked")
    scratch.drop(pointed)
    texts = docs.join(asked.select("key"), "key", "left_semi").dropDuplicates(["key"])
    phrases = texts.join(asked, "key").select("lang", "text", "seed", "asked").mapInArrow(_read(longest), "lang string, n int, phrase string, c long")
    phrases = scratch.write(phrases, "phrases")
    scratch.drop(asked)
    for f in filters:
        f.destroy()
    return phrases


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    top: int = 2000,
    covered_percent: int = 50,
    group_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """Phrases whose words occur together more often than apart, best first in each group of texts.

    Rows: lang, rank (from 1), phrase (words one space apart), a (occurrences
    of the phrase), l and r (of the parts before and after its weakest cut), n
    (words of the group), score (floor of 1000000 a a / (l r), exact).

    A-Z count as lower case.  Texts are split at ``.,;:!?`` and line ends into
    pieces and at spaces and tabs into words; phrases lie inside a piece and
    have 2 to ``longest`` words and ``least`` occurrences, overlaps included.  Of
    the cuts the one with the lowest score counts, of equal ones the first.  A
    phrase inside a longer one with ``covered_percent`` of its occurrences is
    left out.  The order is score, then a, both falling, then the phrase by its
    bytes; the first ``top`` rows of each group are given.

    Null groups are one group, ``und``; null and empty texts have no words;
    repeated rows count each; an empty table gives an empty result; further
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    phrases = phrase_counts(docs, scratch, longest, least, group_col, text_col)
    words = F.split("phrase", " ")
    several = phrases.filter("n >= 2").select("lang", "n", "phrase", F.col("c").alias("a"), words.alias("w"))

    cuts = several.select("lang", "phrase", "a", "n", "w", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("rest"),
    )
    parts = phrases.filter(f"n between 1 and {longest - 1}")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("c").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("c").alias("r")), ["lang", "rest"])
    wide = {c: F.col(c).cast("decimal(15,0)") for c in "alr"}
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", (wide["a"] * wide["a"] * 1000000).alias("top"), (wide["l"] * wide["r"]).alias("below"))
    cuts = cuts.withColumn("score", F.expr("top div below"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut")).select("lang", "phrase", "cut.*")

    size, at = F.col("size"), F.col("at")
    inside = several.filter("n >= 3").select("lang", "a", "n", "w", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("size"))
    inside = inside.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("n") - size + 1)).alias("at"))
    inside = inside.select("lang", "a", F.array_join(F.slice("w", at, size), " ").alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = lowest.join(most, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("most") < covered_percent * F.col("a"), F.lit(True)))

    # the best of each group among the best of its parts, so that no group is sorted whole in one task
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.withColumn("part", F.pmod(F.hash("phrase"), F.lit(max(parts, 64))))
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = phrases.filter("n = 0").select("lang", F.col("c").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with texts as (
  select coalesce(lang, 'und') as lang, row_number() over () as doc,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as pieces
  from documents
),
pieces as (select lang, doc, unnest(pieces) as piece, generate_subscripts(pieces, 1) as piece_no from texts),
listed as (select lang, doc, piece_no, regexp_extract_all(piece, '[^ \t]+') as ws from pieces),
words as (select lang, doc, piece_no, unnest(ws) as w, generate_subscripts(ws, 1) as pos from listed),
grams as (
  select lang, w as w1, lead(w, 1) over p as w2, lead(w, 2) over p as w3
  from words window p as (partition by doc, piece_no order by pos)
),
total as (select lang, count(*) as n from grams group by lang),
f1 as (select lang, w1 as phrase, count(*) as f from grams group by all),
f2 as (select lang, w1, w2, w1 || ' ' || w2 as phrase, count(*) as f from grams where w2 is not null group by all having count(*) >= 10),
f3 as (select lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3 as phrase, count(*) as f from grams where w3 is not null group by all having count(*) >= 10),
cuts as (
  select c.lang, c.phrase, c.f as a, 1 as k, x.f as l, y.f as r from f2 c
    join f1 x on x.lang = c.lang and x.phrase = c.w1 join f1 y on y.lang = c.lang and y.phrase = c.w2
  union all
  select c.lang, c.phrase, c.f, 1, x.f, y.f from f3 c
    join f1 x on x.lang = c.lang and x.phrase = c.w1 join f2 y on y.lang = c.lang and y.phrase = c.w2 || ' ' || c.w3
  union all
  select c.lang, c.phrase, c.f, 2, x.f, y.f from f3 c
    join f2 x on x.lang = c.lang and x.phrase = c.w1 || ' ' || c.w2 join f1 y on y.lang = c.lang and y.phrase = c.w3
),
scored as (select *, (1000000::hugeint * a * a) // (l::hugeint * r) as score from cuts),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (
  select lang, phrase, max(f) as most
  from (select lang, w1 || ' ' || w2 as phrase, f from f3 union all select lang, w2 || ' ' || w3, f from f3) group by all
),
kept as (
  select c.* from lowest c left join inside i on i.lang = c.lang and i.phrase = c.phrase
  where i.most is null or 100 * i.most < 50 * c.a
),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked join total using (lang) where rank <= 2000
"""


@query("op11_phrases", SQL)
def op11(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
