"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from roleweave.llm import queries
from roleweave.llm.periodic_runs import Pairs, Shape, periodic_runs, runs_of, suffixes

DOC = "doc_id long, text string, n long, runs string, id string"


def brute(words, shape=Shape()):
    """Stretches of least period q, found for each q by comparing words q apart."""
    n, found = len(words), {}
    for q in range(1, n // shape.periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shape.words, shape.periods * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((i, e - i, q) for (i, e), q in found.items()), key=lambda r: (r[0], r[2]))


def stretches(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        block = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        out += block * rng.randint(1, 7) + block[: rng.randint(0, len(block))]
    return out


def test_runs_of_random_words():
    rng = random.Random(7)
    for t in range(1500):
        words = stretches(rng) if t % 2 else [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        shape = [Shape(), Shape(4, 2), Shape(2, 2), Shape(9, 3)][t % 4]
        numbers = np.array([ord(w) for w in words], np.int64)
        assert runs_of(numbers, shape) == brute(words, shape), (words, shape)


def test_suffix_array_and_tree():
    words = np.array([ord(c) for c in "abcabcabcabcx"], np.int64)
    places, common = suffixes(words, 5)
    text = "".join(map(chr, words))
    assert [text[i:] for i in places] == sorted(text[i:] for i in places)
    for a, b, c in zip(places, places[1:], common[1:]):
        assert text[a : a + c] == text[b : b + c] and text[a : a + c + 1] != text[b : b + c + 1]
    pairs = Pairs([-1, *words[:-1].tolist()], Shape())
    assert pairs.walk(places.tolist(), common.tolist()) == {(0, 12): 3}


def test_long_texts_of_one_word():
    assert runs_of(np.zeros(200_000, np.int64), Shape()) == [(0, 200_000, 1)]
    block = np.arange(50_000)
    assert runs_of(np.concatenate([block, block, block, block, block[:7]]), Shape()) == [(0, 200_007, 50_000)]


TEXTS = [
    (1, "a b a b a b a b c"),
    (2, "x " * 5),
    (3, "x " * 6),
    (4, "  q\tx\nx x\x0bx x\x0cx\r z z z z z z z"),
    (5, None),
    (6, ""),
    (7, " \n "),
    (8, "é ü " * 30 + "é"),
    (None, "a a a a a a"),
    (1, "a b a b a b a b c"),
    (9, " ".join(str(i % 137) for i in range(9000)) + " end " + "y " * 1000),
    (10, " ".join(map(str, range(5000)))),
]


def expected(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return len(words), runs, kept


def test_periodic_runs(spark):
    docs = spark.createDataFrame([(i, t, 5, "r", "z") for i, t in TEXTS], DOC).repartition(3)
    got = sorted((str(r["id"]), r["n"], [tuple(x) for x in r["runs"]], r["kept"], r["kept_sha256"]) for r in periodic_runs(docs).collect())
    want = []
    for i, t in TEXTS:
        n, runs, kept = expected(t)
        want.append((str(i), n, runs, kept.decode() if runs else None, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=lambda r: r[:3])
    assert periodic_runs(docs.limit(0)).collect() == []


def test_query(spark, tmp_path):
    rows = [(i, " ".join(str((i * j) % (3 + i % 11)) for j in range(i * 3 % 500)) if i % 50 else None) for i in range(400)]
    rows += [(None, "a a a a a a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for i, t in rows:
        words = (t or "").split()
        h, n = (1 if i is None else zlib.crc32(str(i).encode())), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
            planted += 1
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        gone = {j for s, m, q in runs for j in range(s + q, s + m)}
        assert got[i] == {
            "doc_id": i,
            "n_runs": len(runs),
            "start": best[0],
            "length": best[1],
            "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if runs else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in gone).encode()).hexdigest(),
        }
    assert planted > 20
