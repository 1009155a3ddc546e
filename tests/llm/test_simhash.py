"""SimHash groups against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from roleweave.llm import queries
from roleweave.llm.simhash import BLOCKS, anchors, errors, fingerprints, joining_links, near_fingerprints

DOC = "doc_id long, text string, fp long, component long, id string"


def brute_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, threshold):
    """Smallest id reachable for each (id, fingerprint), by all pairs."""
    group = list(range(len(prints)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if None not in (prints[i][0], prints[j][0]) and (prints[i][1] ^ prints[j][1]).bit_count() <= threshold:
                group[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        least[top(i)] = min(x for x in (k, least.get(top(i))) if x is not None) if k is not None else None
    return [least[top(i)] for i in range(len(prints))]


def test_codes_are_perfect():
    for length, generator, radius in BLOCKS:
        bounds, patterns = errors(length, generator, radius, 0)
        assert (np.diff(bounds) == 1).all()  # each syndrome has one nearest codeword
        assert max(int(p).bit_count() for p in patterns) == radius


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
def test_pairs_meet_at_an_anchor(threshold):
    rng = random.Random(threshold)
    reach = threshold - threshold // 2
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), threshold):
            y ^= 1 << b
        at, anchor = anchors(np.array([x, y], np.uint64), reach)
        mine, other = set(anchor[at == 0].tolist()), set(anchor[at == 1].tolist())
        assert mine & other
        assert len(mine) == (at == 0).sum()


def test_joining_links():
    rng = np.random.default_rng(3)
    words = np.unique(rng.integers(0, 1 << 9, 200, dtype=np.uint64))
    links = joining_links(words, 1)
    assert all((a ^ b).bit_count() <= 1 for a, b in links) and len(links) < len(words)
    want = brute_groups([(int(w), int(w)) for w in words], 1)
    up = {int(w): int(w) for w in words}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    assert [top(int(w)) for w in words] == want


def corpus():
    rng = random.Random(11)
    base = [[f"w{rng.randint(0, 400)}é" for _ in range(rng.randint(4, 400))] for _ in range(25)]
    rows = [(None, "one two three"), (1, ""), (2, None), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (6, "one two")]
    for k, words in enumerate(base):
        for j in range(14):
            near = list(words)
            for _ in range(j % 4):
                near[rng.randrange(len(near))] = "changed"
            rows.append((100 + 20 * k + j, "  ".join(near).upper() if j % 3 else " ".join(near)))
    return rows


@pytest.mark.parametrize("threshold,crowd", [(2, 2000), (2, 1), (3, 2), (1, 1), (6, 3)])
def test_groups(spark, threshold, crowd):
    rows = corpus()
    if threshold == 6:
        rows = rows[:120]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], DOC).repartition(4)
    prints = [(i, brute_fingerprint(t, 3)) for i, t in rows]
    assert [fingerprints((t or "").encode(), 3) for _, t in rows] == [p for _, p in prints]
    want = sorted((str(i), f, c if i is not None else None) for (i, f), c in zip(prints, brute_groups(prints, threshold)))
    got = near_fingerprints(docs, 3, threshold, crowd).collect()
    assert sorted((str(r["id"]), r["fp"] % 2**64, r["component"]) for r in got) == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want}) or threshold < 2


def test_hash_is_that_of_spark(spark):
    row = spark.createDataFrame([("abc é d",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row["h"] % 2**64 == xxhash.xxh64_intdigest("abc é d".encode(), 42)


def test_query(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_simhash"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    by_id = {r["doc_id"]: r for r in got.collect()}
    for i, t in rows:
        assert by_id[i]["fingerprint"] == f"{brute_fingerprint(t, 3):016x}"
    assert by_id[2]["component_id"] == 1
    empty = near_fingerprints(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == []
