"""Operators on texts against brute force, on a small fixture with awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import near_duplicates
from roleweave.llm.decontaminate import contaminated_words
from roleweave.llm.licenses import KNOWN, known_licenses, scan_licenses
from roleweave.llm.line_dedup import blocks, patience, remove_shared_lines
from roleweave.llm.minhash import near_duplicate_groups
from roleweave.llm.quality_rules import base_failed, text_statistics
from roleweave.llm.relative_lz import remove_earlier_words
from roleweave.llm.suffix_dedup import remove_repeated_bytes

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, id string, n long, h string, key string"


def word(i):
    return f"w{i * 7919 % 104729}é"


def prose(lo, hi):
    return " ".join(word(i) + ("\n" if i % 17 == 0 else "") for i in range(lo, hi))


TEXTS = [
    (1, prose(0, 400)),
    (2, prose(0, 400)),  # exact copy
    (3, prose(100, 220) + " " + prose(1000, 1100) + " " + prose(300, 360)),  # passages of an earlier text
    (4, "a" * 1500),  # repeats itself
    (5, prose(2000, 2060) + " x " + prose(2000, 2060)),
    (6, prose(0, 395) + " changed at the end"),
    (7, None),
    (8, ""),
    (9, " \n\t "),
    (10, "one two"),
    (11, "One TWO"),
    (12, prose(3000, 9000)),
    (13, prose(3000, 9000).upper()),
    (14, prose(5000, 5049) + " end"),  # one word too short
    (15, prose(5000, 5050) + " end"),
    (None, prose(0, 400)),
    (1, prose(0, 400)),  # repeated row
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, "y", "z") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def pairs(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_repeated_bytes(docs):
    raw = [(i, (t or "").encode()) for i, t in TEXTS]
    count = Counter(b[i : i + 400] for _, b in raw for i in range(len(b) - 399))
    want = Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        want[i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    got = remove_repeated_bytes(docs).withColumn("runs", F.size("spans"))
    assert pairs(got, "id", "n", "n_removed", "runs", "kept_sha256") == want


def test_earlier_words(docs):
    words = [(i, WORD.findall((t or "").encode())) for i, t in TEXTS]
    least = {}
    for i, w in words:
        for p in range(len(w) - 49):
            if i is not None:
                least[tuple(w[p : p + 50])] = min(i, least.get(tuple(w[p : p + 50]), i))
    want = Counter()
    for i, w in words:
        gone = bytearray(len(w))
        for p in range(len(w) - 49):
            if i is not None and least[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    got = remove_earlier_words(docs)
    assert pairs(got, "id", "n", "n_removed", "kept_sha256") == want
    assert any(n for _, _, n, _ in want)


def test_earlier_words_again_in_one_text(spark):
    """A passage of an earlier text that occurs twice in a later one goes at both places."""
    p, c, d = prose(20000, 20060), prose(21000, 21080), prose(22000, 22080)
    twice = " ".join([c, p, d, c, p, d])
    rows = [
        (1, " ".join([prose(23000, 23080), p, prose(24000, 24080)])),
        (2, twice),
        (2, twice + " end"),
        (3, " ".join([prose(25000, 25080), c, p, d, prose(26000, 26080)])),
    ]
    got = remove_earlier_words(spark.createDataFrame(rows, "doc_id long, text string"))
    words = [(i, WORD.findall(t.encode())) for i, t in rows]
    want = Counter()
    for i, w in words:
        earlier = {tuple(v[p : p + 50]) for j, v in words if j < i for p in range(len(v) - 49)}
        gone = bytearray(len(w))
        for p in range(len(w) - 49):
            if tuple(w[p : p + 50]) in earlier:
                gone[p : p + 50] = b"\1" * 50
        want[i, sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    assert pairs(got, "id", "n_removed", "kept_sha256") == want
    assert [n for i, n, _ in want if i == 2] == [120, 120]


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, shingle, percent):
    sets = []
    for i, t in TEXTS:
        w = WORD.findall(bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode()))
        n = min(shingle, len(w))
        sets.append((i, frozenset(tuple(w[p : p + n]) for p in range(len(w) - n + 1)) if n else frozenset()))
    near = defaultdict(set)
    for i, a in sets:
        for j, b in sets:
            if a and b and None not in (i, j) and 100 * len(a & b) >= percent * len(a | b):
                near[i].add(j)
    want = Counter()
    for i, a in sets:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        least = None if i is None else min(seen)
        want[i, len(a), least, i is None or least == i] += 1
    got = near_duplicate_groups(docs, shingle, percent)
    assert pairs(got, "id", "n_shingles", "component", "kept") == want


def test_near_duplicates_that_no_star_links(spark):
    """A chain: neighbours are alike, ends are not."""
    rows = [(i, " ".join(word(j) for j in range(8 * i, 8 * i + 200))) for i in range(30)]
    got = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r["component"] for r in got.collect()} == {0}


def test_near_duplicates_under_one_id(spark):
    """The pipeline drops rows, not ids: of each group one row stays, and no other text of its id goes."""
    a, near, b, c = prose(0, 200), prose(0, 200) + " end", prose(30000, 30200), prose(40000, 40200)
    rows = [(3, a), (3, near), (3, c), (5, a), (5, b), (7, b), (7, None), (None, a), (3, "")]
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert got[3, a] + got[3, near] == 1
    del got[3, a], got[3, near]
    assert +got == Counter([(3, c), (5, b), (7, None), (None, a), (3, "")])


ITEM = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = [(1, prose(110, 130)), (2, "One, two!"), (3, "..."), (4, None), (5, prose(1010, 1021)), (None, prose(3100, 3120)), (6, prose(110, 130))]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contaminated_words(spark, docs, block_bytes):
    def words(t):
        return ITEM.findall(bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode()))

    windows = defaultdict(set)
    for i, t in ITEMS:
        w = words(t)
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(i)
    want = Counter()
    for i, t in TEXTS:
        w = words(t)
        hit, found = bytearray(len(w)), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[p : p + n]))):
                    hit[p : p + n] = b"\1" * n
                    found |= x
        ids = tuple(sorted(str(x) for x in found if x is not None))
        want[i, len(w), sum(hit), ids, sum(hit) > 0 and 20 * sum(hit) >= len(w)] += 1
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = contaminated_words(docs, items, block_bytes=block_bytes)
    rows = Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got.collect())
    assert rows == want


def test_text_statistics(docs):
    want = Counter()
    text = re.compile("[^\x20\x09-\x0d]+")
    for i, t in [*TEXTS, (20, "a b c d e\na b c d e\nf # g\na b c d e")]:
        t = t or ""
        w = text.findall(t)
        count = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
        again = bytearray(len(w))
        for p in range(len(w) - 4):
            if count[tuple(w[p : p + 5])] > 1:
                again[p : p + 5] = b"\1" * 5
        lines = [x for x in t.split("\n") if text.search(x)]
        symbols = sum(t.count(x) for x in "#*$%&|<>")
        failed = len(w) < 10 or 100 * sum(again) > 20 * len(w)
        want[i, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), sum(again), failed] += 1
    more = docs.select("doc_id", "text").unionByName(
        docs.sparkSession.createDataFrame([(20, "a b c d e\na b c d e\nf # g\na b c d e")], "doc_id long, text string")
    )
    got = text_statistics(more).withColumn("failed", base_failed())
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert pairs(got, "doc_id", *counts, "failed") == want


def test_patience():
    assert patience(list("abcd"), list("xbcy")) == [(1, 1), (2, 2)]
    assert patience(list("aab"), list("aab")) == [(0, 0), (1, 1), (2, 2)]
    assert patience([], list("a")) == []
    aligned = patience(list("pqabcrs"), list("abcxrs"))
    assert aligned == [(2, 0), (3, 1), (4, 2), (5, 4), (6, 5)]
    assert blocks(aligned, [1, 1, 2, 2, 2, 1, 1], 5) == [(2, 5)]


def test_shared_lines(spark):
    lines = [f"line number {i} of the {word(i)} text" for i in range(12)]
    rows = [
        (1, "\n".join(lines[:6])),
        (2, "\n".join(["first own line here too", *lines[2:5], "last own line here too"])),
        (3, "\n".join(lines[:6])),
        (3, "\n".join(lines[:6])),
        (4, "\n".join(lines[6:])),
        (5, None),
        (6, ""),
        (None, "\n".join(lines[:6])),
        (7, "short\n" + lines[11] + "\nother words that stay as they are"),
    ]
    got = {(r["doc_id"], r["kept_text"]) for r in remove_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"), common_share=0.8).collect()}
    assert got == {
        (1, rows[0][1]),
        (2, "first own line here too\nlast own line here too"),
        (3, ""),
        (4, rows[4][1]),
        (5, None),
        (6, ""),
        (None, rows[0][1]),
        (7, "short\nother words that stay as they are"),
    }


def test_shared_lines_of_any_number(spark):
    """Lines that are repeated in the first holder, in all texts, moved, or too short one by one; two texts of one id."""
    hot, b1, b2 = "this line is held by every single text", "three words here", "and three more"
    rows = [
        (1, f"own words of one\n{hot}\nother words of one\n{hot}\n{b1}"),
        (2, f"own words of two\n{hot}\n{b2}\nthe end of text two"),
        (3, f"own words of three\n{b1}\n{b2}\nthe end of text three\n{hot}"),
        (4, f"own words of four\n{hot}\n{b1}\n{b2}\nthe end of text four"),
        (5, "a first block of some words\nx\na second block of some words"),
        (6, "a second block of some words\ny\na first block of some words"),
        (7, "one\ntwo\n\nthree four\nfive six\nseven"),
        (7, "another text under the same id\nz"),
        (8, "0\ntwo\n\nthree four\nfive six\n9\nanother text under the same id"),
        (9, hot + "\n" + hot),
    ]
    texts = [(i, t.split("\n")) for i, t in rows]
    want = Counter()
    for i, a in texts:
        gone = set()
        for lo in range(len(a)):
            for hi in range(lo + 1, len(a) + 1):
                if len(" ".join(a[lo:hi]).split()) >= 5:
                    if any(j < i and a[lo:hi] == b[k : k + hi - lo] for j, b in texts for k in range(len(b))):
                        gone |= set(range(lo, hi))
        want[i, "\n".join(x for n, x in enumerate(a) if n not in gone)] += 1
    got = remove_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert pairs(got, "doc_id", "kept_text") == want
    assert want[4, "own words of four\nthe end of text four"] and want[6, "y"] and want[9, ""]


def test_licenses(spark):
    rows = [
        (1, "Copyright (c) 2020 Somebody\n  released UNDER the MIT licence!\n"),
        (2, "Some words.\nLicensed under the Apache License, Version 2.0.\nMore.\nReleased under the MIT License"),
        (3, None),
        (4, "..."),
        (5, "Released under the MIT License, but not only"),
        (None, "Released under the MIT License"),
    ]
    got = {r["id"]: (r["license"], r["notices"], r["n_notices"]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known_licenses(spark)).collect()}
    assert got == {
        1: ("MIT", ["MIT"], 1),
        2: (None, ["Apache-2.0", "MIT"], 2),
        3: (None, [], 0),
        4: (None, [], 0),
        5: (None, [], 0),
        None: ("MIT", ["MIT"], 1),
    }


def test_whole_licenses(spark):
    """Line ends, comment marks, titles and copyright lines of any kind do not matter."""
    mit, isc = (next(t for n, t in KNOWN if n == name and "\n" in t) for name in ("MIT", "ISC"))
    head = "MIT License\n\nCopyright (c) 2020 X\n\n"
    wrapped = isc.replace("the above copyright", "the above\ncopyright")
    assert wrapped != isc
    rows = [
        (1, mit.replace("\n", "\r\n"), "MIT"),
        (2, "/*\n" + "".join(f" * {x}\n" for x in (head + mit).split("\n")) + " */\n", "MIT"),
        (3, head + mit, "MIT"),
        (4, "The MIT License (MIT)\r\n\r\nCopyright (c) The Authors\r\n---\r\n" + mit, "MIT"),
        (5, "Copyright Some Company, Inc.\nAll rights reserved.\n\n" + mit, "MIT"),
        (6, "ISC License\n\n© Somebody\n\n" + wrapped, "ISC"),
        (7, "Released under the\nMIT License", "MIT"),
        (8, mit + "\nBut not on Sundays.", None),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["id"]: r["license"] for r in scan_licenses(docs, known_licenses(spark)).collect()}
    assert got == {i: name for i, _, name in rows}


@pytest.mark.parametrize(
    "run",
    [
        remove_repeated_bytes,
        remove_earlier_words,
        near_duplicate_groups,
        remove_shared_lines,
        lambda d: scan_licenses(d, known_licenses(d.sparkSession)),
        lambda d: contaminated_words(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    ],
)
def test_empty_table(docs, run):
    assert run(docs.limit(0)).collect() == []
