"""Trees, matching, ranks, quantiles and networks on small hand-made input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roleweave.functions import stats, text
from roleweave.operators import lexicon, matching, network, phrases, ranking, tree
from roleweave.session import materialize


def test_roots_with_cycles_and_detached_heads(spark):
    heads = {1: 0, 2: 1, 3: 2, 4: -1, 5: 4, 6: 7, 7: 6, 8: 7}
    t = spark.createDataFrame([(1, i, h) for i, h in heads.items()], "unit_id long, id int, head int")
    got = {r["id"]: r["root_id"] for r in tree.with_roots(t).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: None, 7: None, 8: None}


def test_descendants_are_cycle_guarded(spark):
    t = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 2)], "unit_id long, id int, head int")
    t = t.withColumn("f", F.array(F.lit("x")))
    got = {(r["ancestor"], r["id"]) for r in tree.descendants_in(t, "f").collect()}
    assert got == {(2, 1), (1, 1), (1, 2), (2, 2), (2, 3), (1, 3)}


def _tokens(spark, forms, pos=None):
    rows = [(1, i, f, f.rstrip("s") + "x", (pos or ["N"] * len(forms))[i - 1], 0) for i, f in enumerate(forms, 1)]
    return spark.createDataFrame(rows, "unit_id long, id int, form string, lemma string, pos string, head int")


def test_ladder_on_phrases(spark):
    lex = spark.createDataFrame([("police", 1), ("officer", 2), ("chief", 3), ("police officer", 4), ("was", 5)], "term string, id int")
    t = _tokens(spark, ["police officers", "chief/officer", "officers", "was", "wa", "Police"])
    m = matching.match_lexicon(t, matching.match_vocabulary(matching.vocabulary(t), lex))
    got = {r["form"]: [f["term"] for f in r["forms"]] for r in m.collect()}
    assert got["police officers"] == ["police officer"]
    assert got["chief/officer"] == ["chief", "officer"]
    assert got["officers"] == ["officer"]
    assert got["was"] == ["was"] and got["wa"] == [] and got["Police"] == ["police"]


def test_longest_phrase_wins_and_heads_follow(spark):
    rows = [(1, 1, "new", 3), (1, 2, "york", 3), (1, 3, "city", 4), (1, 4, "cops", 0), (1, 5, "york", 4)]
    t = spark.createDataFrame([(u, i, f, f, "N", h) for u, i, f, h in rows], "unit_id long, id int, form string, lemma string, pos string, head int")
    phrases = spark.createDataFrame([("new york",), ("new york city",), ("city cops",)], "term string")
    got = [(r["id"], r["form"], r["head"]) for r in matching.merge_phrases(t, phrases).orderBy("id").collect()]
    assert got == [(1, "new york city", 2), (2, "cops", 0), (3, "york", 2)]


def test_phrases_of_any_length_and_overlap(spark):
    t = _tokens(spark, "a a a a a b c d b c a a".split())
    for entries, want in [
        (["a a"], [(1, 2), (3, 2), (11, 2)]),
        (["a a a", "b c d", "c d b c"], [(1, 3), (6, 3)]),
        (["a a", "a a a a", "a b", "b c", "x y z"], [(1, 4), (5, 2), (9, 2), (11, 2)]),
        (["a", "d b c a a"], [(8, 5)]),
    ]:
        found = matching.phrase_spans(t, spark.createDataFrame([(e,) for e in entries], "term string"))
        assert sorted((r["start"], r["len"]) for r in found.collect()) == want


def test_score_with_entries_of_signs(spark):
    entries = {"good": 2.0, "can't stand": -3.0, "stand": 0.5, "well-known": 1.5, "known": 0.25, ":)": 4.0, ":": 0.125, "not good": -2.5, "new york city": 1.0, "york": 0.0625, "\u2764": 3.0, "100": 8.0}
    valence = spark.createDataFrame(list(entries.items()), "term string, value double")
    texts = [
        ("a", "I can't stand it, GOOD"), ("b", "a well-known man, well known"), ("c", "fine:) but : )"), ("d", "not good not  good"), ("e", "New York  City york"),
        ("f", "\u2764\u2764 100 x100"), ("g", None), ("h", ""), ("i", "not not good good"), ("j", "can' t stand"),
    ]
    df = spark.createDataFrame([(k, t, "x") for k, t in texts], "id string, text string, entry string")
    got = {r["id"]: r["score"] for r in lexicon.lexicon_compound(df, valence, "id").collect()}
    sums = {
        "a": -3.0 + 2.0, "b": 1.5 + 0.25, "c": 4.0 + 0.125, "d": -5.0, "e": 1.0 + 0.0625, "f": 6.0 + 16.0, "g": 0.0, "h": 0.0, "i": -2.5 + 2.0, "j": 0.5,
    }
    for k, s in sums.items():
        assert got[k] == pytest.approx(s / (s * s + 15.0) ** 0.5), k


def test_address_forms(spark):
    flagged = matching.exclude_address_forms(_tokens(spark, ["you", "guys", "oh", "man", "the", "man", ",", "ok"]))
    assert [r["id"] for r in flagged.where("is_address").collect()] == [2, 4, 6]


def test_masking_and_text(spark):
    df = spark.createDataFrame([(["The", "judges", "saw", ",", "a", "Judge"],)], "t array<string>")
    row = df.select(text.mask_identity(F.col("t"), F.lit("judge")).alias("m"), text.unit_text(F.col("t")).alias("u")).first()
    assert row["m"] == "The identity saw , a identity" and row["u"] == "The judges saw, a Judge"


def test_rank_under_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(-1).alias("user_id"), "id")
    got = ranking.bucketed_row_number(df, ["user_id"], ["id"], F.floor(F.col("id") / 100), "rn", "n").toPandas()
    want = got.sort_values("id").groupby("user_id").cumcount() + 1
    assert (got.sort_values("id")["rn"].to_numpy() == want.to_numpy()).all()
    assert (got.groupby("user_id")["n"].first() == got.groupby("user_id").size()).all()


def test_rank_of_null_keys_and_plan(spark):
    df = spark.range(500).select(F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("user_id"), "id")
    ranked = ranking.bucketed_row_number(df, ["user_id"], ["id"], F.when(F.col("id") >= 50, F.floor(F.col("id") / 100)), "rn", "n")
    got = ranked.toPandas().sort_values("id")
    assert len(got) == 500
    want = got.groupby("user_id", dropna=False).cumcount() + 1
    assert (got["rn"].to_numpy() == want.to_numpy()).all()
    assert set(got[got["user_id"].isna()]["n"]) == {250}
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 500") == 2


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.lognormal(size=999), np.full(400, 0.5)])
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)], "k int, v double")
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    for small in (200_000, 40, 1):
        found = ranking.exact_quantiles(df, ["k"], "v", probs, bins=16, small=small)
        got = {(r["k"], r["prob"]): r["quantile"] for r in found.collect()}
        for k in (0, 1):
            for p in probs:
                assert got[k, p] == pytest.approx(np.quantile(values[k::2], p))


def test_quantiles_of_null_keys_and_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, None), (2, 5.0)], "k int, v double")
    got = {(r["k"], r["quantile"]) for r in ranking.exact_quantiles(df, ["k"], "v", [0.5]).collect()}
    assert got == {(None, 2.0), (2, 5.0)}
    assert ranking.exact_quantiles(df.limit(0), ["k"], "v", [0.5]).collect() == []
    assert [r["quantile"] for r in ranking.exact_quantiles(df, [], "v", [0.5]).collect()] == [3.0]


def test_bins_of_a_long_tail_are_even(spark):
    """Heavy tails, a hot key and a second key: no bin of a key holds twice the mean."""
    rng = np.random.default_rng(1)
    tail = np.concatenate([rng.pareto(0.3, 30_000), -rng.pareto(0.2, 10_000)])
    df = spark.createDataFrame([(0, float(v)) for v in tail] + [(1, float(v) ** 3) for v in range(8000)], "k int, v double")
    sizes = ranking.balanced_bins(df, "k", "v", 64).groupBy("k", "_bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    for k, n in ((0, 40_000), (1, 8000)):
        rows = sorted((r for r in sizes.collect() if r["k"] == k), key=lambda r: r["_bin"])
        assert max(r["n"] for r in rows) <= 2 * n / 64 and sum(r["n"] for r in rows) == n
        assert all(a["hi"] < b["lo"] for a, b in zip(rows, rows[1:]))


def test_split_keeps_one_more_for_training(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("user_id"), "id")
    s = ranking.split_train_test(df, 0.15, order=["id"], bucket=F.lit(0), unit="id")
    assert {(r["user_id"], r["split"]): r["count"] for r in s.groupBy("user_id", "split").count().collect()} == {
        (0, "train"): 44, (0, "test"): 6, (1, "train"): 44, (1, "test"): 6,
    }


def test_stem_chain(spark):
    words = ["need", "needs", "needed", "needss", "bed", "beded", "bededs"]
    df = spark.createDataFrame(list(enumerate(words)), "pos long, term string")
    got = {r["term"] for r in lexicon.drop_stem_duplicates(df).collect()}
    seen = set()
    for w in words:
        if not (w.endswith("s") and w[:-1] in seen or w.endswith("ed") and w[:-2] in seen):
            seen.add(w)
    assert got == seen


def test_similarities(spark):
    one, half = F.lit(1.0), F.lit(0.5)
    row = spark.range(1).select(
        stats.bhattacharyya_similarity(one, one, half, half).alias("same"),
        stats.euclid_similarity([one], [F.lit(4.0)]).alias("e"),
        stats.max_abs(F.array(F.lit(0.5), F.lit(-2.0), F.lit(2.0))).alias("m"),
        stats.max_abs(F.array().cast("array<double>")).alias("none"),
    ).first()
    assert (row["same"], row["e"], row["m"], row["none"]) == (1.0, 0.25, -2.0, None)


# -- networks ------------------------------------------------------------------------


def _edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "src long, dst long")
    got = {r["vertex"]: r["component"] for r in network.connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[100] == got[101] == 100
    assert network.largest_component(e).count() == 30


def test_communities_of_two_cliques(spark):
    a, b = "abcd", "wxyz"
    rows = [(p, q, 1.0) for g in (a, b) for p in g for q in g if p < q] + [("d", "w", 0.1)]
    got = {r["vertex"]: r["community"] for r in network.communities(_edges(spark, rows)).collect()}
    assert len({got[v] for v in a}) == 1 and len({got[v] for v in b}) == 1 and got["a"] != got["z"]


def test_betweenness_on_a_path_and_a_square(spark):
    path = _edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)])
    got = {r["vertex"]: r["betweenness"] for r in network.betweenness(path).collect()}
    assert got == {"a": 0.0, "b": 2.0, "c": 2.0, "d": 0.0}
    square = _edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("a", "d", 1.0), ("d", "c", 1.0)])
    assert {r["betweenness"] for r in network.betweenness(square).collect()} == {0.5}
    # A heavy direct edge is avoided.
    detour = _edges(spark, [("a", "c", 5.0), ("a", "b", 1.0), ("b", "c", 1.0)])
    assert {r["vertex"]: r["betweenness"] for r in network.betweenness(detour).collect()}["b"] == 1.0


def test_components_put_ends_in_the_place_of_vertices(spark, monkeypatch):
    """What is left of the edges shrinks by round; a vertex beside a null is its own component."""
    written = []

    def spy(df, name, *args):
        out = materialize(df, name, *args)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(network, "materialize", spy)
    rows = [(i, i + 1) for i in range(0, 400)] + [(900, 901), (901, 900), (950, None)]
    e = spark.createDataFrame(rows, "src long, dst long")
    got = {r["vertex"]: r["component"] for r in network.connected_components(e).collect()}
    assert got == {i: 0 for i in range(401)} | {900: 900, 901: 900, 950: 950, None: 950}
    links = [n for name, n in written if name == "links"]
    assert links[0] == len(rows) and all(b <= a / 2 for a, b in zip(links, links[1:])) and links[-1] == 0


def test_longer_terms_are_looked_up_whole(spark):
    """Terms that share words with the text make no rows, and spellings of one run count once."""
    terms = [("of the", 1.0), ("of  the", 1.0)] + [(f"of the w{i}", 2.0) for i in range(50)]
    entries = lexicon.valence_entries(spark.createDataFrame(terms, "term string, value double"))
    assert entries.count() == 51 and "at" not in entries.columns
    texts = spark.createDataFrame([(1, "Of the w\n of the"), (2, "of\tthe w 7, of-the"), (3, None)], "k long, text string")
    got = {r["k"]: r["score"] for r in lexicon.lexicon_compound(texts, spark.createDataFrame(terms, "term string, value double"), "k").collect()}
    assert got == pytest.approx({1: 2 / 19**0.5, 2: 1 / 16**0.5, 3: 0.0})
    twice = texts.where("k = 2").unionByName(texts.where("k = 2"))
    once = [r["score"] for r in lexicon.lexicon_compound(twice, spark.createDataFrame(terms, "term string, value double"), "k").collect()]
    assert once == pytest.approx([0.25, 0.25])


def test_token_spaces_are_stripped_without_a_pattern(spark):
    df = spark.createDataFrame([(" a\t\n b1 .é",)], "t string").select(phrases.text_tokens(F.col("t")).alias("x"))
    assert [(t["w"], t["gap"]) for t in df.first()["x"]] == [("a", True), ("b", True), ("1", False), (".", True), ("é", False)]
    assert "regexp_replace" not in df._jdf.queryExecution().toString().lower()


def test_priors_shuffle_identities_only(spark, tmp_path):
    """A document's mean goes to its distinct identities; rows of one document are one, those of none are left out."""
    from roleweave.catalog import lexicon as catalog

    rows = [(1, "s1", "Bb bb cats cats"), (1, "s1", "Bb bb cats cats"), (2, "s1", "cats bb"), (3, "s2", "cats"), (4, None, "bb, cats"), (None, "s3", "cats bb"), (5, "s2", None)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, source string, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.empirical(spark, str(tmp_path))
    e = ((2 * 13 + 98 * 7 + 98 * 3) % 87 - 43) / 10 + 0.0001
    got = {(r["user_id"], r["word"]): (r["total"], r["n"]) for r in out.where("dim = 'e'").collect()}
    assert got == {("s1", "cats"): (pytest.approx(2 * e), 2), (None, "cats"): (pytest.approx(e), 1)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    distinct = plan[plan.index("Aggregate [doc_id#") :].splitlines()
    assert any("Join Inner" in line for line in distinct[1:3])
