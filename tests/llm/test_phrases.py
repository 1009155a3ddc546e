"""Phrases against brute force and against SQL."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roleweave.llm import arrays as A
from roleweave.llm import bits
from roleweave.llm import phrases as P
from roleweave.llm import queries
from roleweave.llm.base import Scratch

DATA = os.environ.get("ROLEWEAVE_DATA", "/root/testdata/sf0.001")
DOC = "doc_id long, text string, lang string, n long, score string, phrase string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_counts(rows, longest):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    return counts, total


def brute(rows, longest=3, least=10, top=2000, covered=50):
    counts, total = brute_counts(rows, longest)
    found = []
    for (lang, words), a in counts.items():
        if len(words) < 2 or a < least:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.append((lang, words, a, left, right, score))
    inside = Counter()
    for lang, words, a, *_ in found:
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                inside[lang, words[i : i + n]] = max(inside[lang, words[i : i + n]], a)
    kept = [f for f in found if 100 * inside[f[0], f[1]] < covered * f[2] or not inside[f[0], f[1]]]
    out = []
    for lang in {f[0] for f in kept}:
        mine = sorted((f for f in kept if f[0] == lang), key=lambda f: (-f[5], -f[2], " ".join(f[1]).encode()))
        out += [(lang, i, " ".join(w), a, x, y, total[lang], s) for i, (_, w, a, x, y, s) in enumerate(mine[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(5)
    rows = []
    vocabulary = [f"{'Éx'[rng.random() < 0.9]}{i}" for i in range(40)] + ["a", "A", "ß", "日本", "-", "'", "x y"]
    for i in range(150):
        text = ""
        for _ in range(rng.randint(0, 120)):
            if rng.random() < 0.2:
                text += rng.choice(["New York City", "new york", "in order to go", "a a a a a", "to be or not"])
            else:
                text += rng.choice(vocabulary)
            text += rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \r\n", "\x0b", ";:", " ! "])
        rows.append((text, rng.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "en"), (" .\n", "xx"), ("one", "yy"), ("go on " * 40, "zz"), rows[0], rows[0]]


@pytest.mark.parametrize("longest,least,top,covered", [(3, 10, 2000, 50), (2, 3, 7, 50), (4, 4, 25, 80), (5, 10, 2000, 20)])
def test_collocations(spark, longest, least, top, covered):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, g, 3, "s", "p") for i, (t, g) in enumerate(rows)], DOC).repartition(5)
    got = sorted(tuple(r) for r in P.collocations(docs, longest, least, top, covered).collect())
    assert got == brute(rows, longest, least, top, covered)
    assert len(got) > 10


def test_empty(spark):
    docs = spark.createDataFrame([(1, None, None, 3, "s", "p")], DOC)
    assert P.collocations(docs).collect() == []
    assert P.collocations(docs.limit(0)).collect() == []


def test_counts_with_a_full_bitmap(spark, monkeypatch):
    """A bitmap that marks everything changes the work, not the counts."""
    rows = corpus()
    docs = spark.createDataFrame([(i, t, g, 3, "s", "p") for i, (t, g) in enumerate(rows)], DOC)
    full = np.full((1 << bits.BITS) // 64, A.NONE)
    monkeypatch.setattr(P, "bitmap", lambda names: spark.sparkContext.broadcast(full))
    found = P.phrase_counts(docs, Scratch(spark, "test"))
    got = {(r["lang"], tuple(r["phrase"].split(" ")) if r["n"] else ()): r["c"] for r in found.collect()}
    counts, total = brute_counts(rows, 3)
    want = {k: c for k, c in counts.items() if c >= 10} | {(g, ()): c for g, c in total.items() if c >= 10}
    assert got == want


def test_equal_fingerprints_are_told_apart(spark, monkeypatch):
    """First fingerprints of three bits: nearly all meet, and the second and the texts set them right."""
    names = P.Grams.names

    def few(self, at, n, which):
        h = names(self, at, n, which)
        return h if which else h >> A.U(61) << A.U(61)

    rows = [(t, g) for t, g in corpus()][:40]
    monkeypatch.setattr(P.Grams, "names", few)
    batch = __import__("pyarrow").RecordBatch
    import pyarrow as pa

    data = batch.from_arrays([pa.array([t for t, _ in rows]), pa.array([7] * len(rows)), pa.array(range(len(rows)))], names=["text", "seed", "key"])
    counts = Counter()
    pointers = {}
    for out in P._pointed(3, [])(iter([data])):
        for r in out.to_pylist():
            counts[r["h"], r["k"]] += r["c"]
            pointers[r["h"], r["k"]] = r["key"]
    asked = {}
    for (h, k), key in pointers.items():
        asked.setdefault(key, []).append({"h": h, "k": k, "c": counts[h, k]})
    kind = pa.list_(pa.struct([("h", pa.int64()), ("k", pa.int64()), ("c", pa.int64())]))
    keys = sorted(asked)
    data = batch.from_arrays(
        [pa.array(["g"] * len(keys)), pa.array([rows[k][0] for k in keys]), pa.array([7] * len(keys)), pa.array([asked[k] for k in keys], kind)],
        names=["lang", "text", "seed", "asked"],
    )
    got = {tuple(r["phrase"].split(" ")): r["c"] for out in P._read(3)(iter([data])) for r in out.to_pylist() if r["n"]}
    want, _ = brute_counts([(t, "g") for t, _ in rows], 3)
    assert got == {w: c for (_, w), c in want.items()}


def test_bitmap(spark):
    names = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    for size in (20, 26):
        found = bits.bitmap(spark.createDataFrame([(int(h),) for h in names[:2000]], "h long"), size).value
        hit = bits.marked(found, names.view(np.uint64))
        assert hit[:2000].all() and found.nbytes == (1 << size) // 8
        assert hit[2000:].mean() < 0.05


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(queries.ORACLES["op11_phrases"])
    names = [c[0] for c in want.description]
    got = queries.QUERIES["op11_phrases"](spark, DATA)
    assert got.columns == names
    assert {t for _, t in got.dtypes if t != "string"} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert got.filter(F.col("rank") == 1).count() == 4
