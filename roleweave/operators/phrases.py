"""Entries of several words in token tables and texts.

An entry of n words stands at a place if its n - 1 pairs of neighbouring words
do, each at its offset.  Pairs are the prefixes of length two of a phrase trie
laid out as a table: they are looked up by one join, so what follows it are hits,
whatever the longest entry.  Of the entries at a place the longest wins, and of
those that overlap the leftmost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[ \\t\\n\\f\\r]"
TOKEN = f"{SPACES}*(?:\\pL+|\\pN+|[^ \\t\\n\\f\\r\\pL\\pN])"


def text_tokens(text: Column) -> Column:
    """Array of ``struct<w, gap>``: runs of letters, runs of digits and single other characters; ``gap`` tells of space before."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.struct(F.ltrim(t, F.lit(" \t\n\f\r")).alias("w"), F.ascii(t).isin(*map(ord, " \t\n\f\r")).alias("gap")))


def pair(one: Column, gap: Column, two: Column) -> Column:
    """Key of two neighbouring words; with and without space between them they differ."""
    return F.concat(one, F.when(gap, " ").otherwise("\x01"), two)


def token_pairs(tokens: Column) -> Column:
    """Pairs of neighbouring words of a token array."""
    steps = F.when(F.size(tokens) > 1, F.sequence(F.lit(0), F.size(tokens) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: pair(F.get(tokens, i)["w"], F.get(tokens, i + 1)["gap"], F.get(tokens, i + 1)["w"]))


def glued(tokens: Column) -> Column:
    """Words of a token array, each after what stands between it and the word before; runs of words are named by them."""
    return F.transform(tokens, lambda t: F.concat(F.when(t["gap"], " ").otherwise("\x01"), t["w"]))


def runs(words: Column, n: int) -> Column:
    """Names of the runs of n neighbouring words, by their first; ``words`` are ``glued``."""
    steps = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    first = lambda i: F.substr(F.get(words, i), F.lit(2))
    return F.transform(steps, lambda i: F.concat(first(i), *[F.get(words, i + j) for j in range(1, n)]))


def entry_pairs(entries: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(pair, at, len, and the entry's columns): the pairs of each entry with their offsets."""
    rest = [c for c in entries.columns if c != tokens]
    sized = entries.withColumn("len", F.size(tokens)).where("len > 1")
    return sized.select(*rest, "len", F.posexplode(token_pairs(F.col(tokens))).alias("at", "pair"))


def standing(hits: DataFrame, keys: list[str], entry: list[str]) -> DataFrame:
    """Places (keys, start, len, entry) of entries all of whose pairs were hit; ``hits`` has id, at and len."""
    per = hits.groupBy(*keys, (F.col("id") - F.col("at")).alias("start"), "len", *entry).agg(F.count("*").alias("_n"))
    return per.where("_n = len - 1").drop("_n")


def leftmost(places: Column) -> Column:
    """Of ``struct<start, len, ...>`` the ones that count: at a place the longest, then leftmost first."""
    ordered = F.array_sort(places, lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"]).cast("int")).otherwise((b["len"] - a["len"]).cast("int")))
    none = F.slice(places, 1, 0)

    def step(acc: Column, s: Column) -> Column:
        taken = F.struct((s["start"] + s["len"]).cast("long").alias("free"), F.concat(acc["got"], F.array(s)).alias("got"))
        return F.when(s["start"] >= acc["free"], taken).otherwise(acc)

    start = F.struct(F.lit(-1).cast("long").alias("free"), none.alias("got"))
    return F.aggregate(ordered, start, step, lambda acc: acc["got"])
