"""Constraint algebra against hand values, and extraction on worked sentences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roleweave.operators import coefficients as co
from roleweave.operators import constraints as cs
from roleweave.plans import evaluate, sentiment
from roleweave.plans import forms as pf

OFF = 0.0001
TEACHER, STUDENT = (2.45, 1.75, 0.29), (1.49, 0.31, 0.75)
WORDS = {"instruct": (1.85, 1.65, 0.30), "cocky": (-0.57, 0.58, 1.06), "aggressive": (0.48, 1.64, 1.82)}
SCHEMA = (
    "unit_id long, user_id long, family string, negated boolean, "
    f"operands array<{co.OPERAND_TYPE}>, targets array<int>, pe double, pp double, pa double"
)


def ident(role, i):
    return (role, f"i_{i}", i, None, None, None)


def word(role, w):
    return (role, f"z_{w}", None, *[v + OFF for v in WORDS[w]])


def vec(*ids):
    return F.array(*[F.struct(*[F.lit(v + OFF).alias(d) for v, d in zip(x, "epa")]) for x in ids])


def event(unit, mods, negated=False):
    ops = [ident("a", 0), word("b", "instruct"), ident("o", 1)]
    if mods:
        ops += [word("am", "aggressive"), word("om", "cocky")]
    return (unit, 1, "event", negated, ops, [0, 1], None, None, None)


HAND = {
    (1, 0): [(0.207450, -0.960980), (0.302211, -0.784113), (0.191573, -0.148801)],
    (1, 1): [(0.307477, -1.141313), (0.141688, 0.319103), (0.070025, -0.082514)],
    (2, 0): [(0.080406, -0.553048), (0.106495, -0.192165), (0.078328, 0.160642)],
    (2, 1): [(0.036972, -0.409810), (0.049349, 0.204149), (0.030034, 0.077286)],
}


def test_event_hand_values(spark):
    df = spark.createDataFrame([event(1, False), event(2, True)], SCHEMA).withColumn("vec", vec(TEACHER, STUDENT))
    got = {(r["unit_id"], r["target"], r["dim"]): (r["c0"], r["c1"]) for r in co.quadratic_coefs(df).collect()}
    for (unit, target), dims in HAND.items():
        for d, want in zip("epa", dims):
            assert got[unit, target, d] == pytest.approx(want, abs=2e-6)
    deflection = {r["unit_id"]: r["deflection"] for r in co.unit_deflection(df).collect()}
    assert deflection[1] == pytest.approx(0.728987, abs=2e-6)
    assert deflection[2] == pytest.approx(2.048382, abs=2e-6)


def test_modified_identity(spark):
    cols = co.modified([F.lit(v + OFF) for v in WORDS["aggressive"]], [F.lit(v + OFF) for v in TEACHER])
    row = spark.range(1).select(*cols).first()
    assert list(row) == pytest.approx([0.710729, 1.840411, 1.051916], abs=2e-6)


def _random_constraints(n=40):
    rng = np.random.default_rng(3)
    rows = []
    for u in range(n):
        ids = rng.permutation(4)[:3]
        family = ["event", "equality", "point"][u % 3]
        w = lambda role: (role, "z", None, *rng.normal(size=3).tolist())
        ops = [ident("a", int(ids[0]))]
        if family != "point":
            ops += [ident("o", int(ids[1])) if u % 2 else w("o"), w("am"), ident("om", int(ids[2]))]
        if family == "event":
            ops += [w("b"), w("b")]
        targets = sorted({o[2] for o in ops if o[2] is not None})
        point = tuple(rng.normal(size=3).tolist()) if family == "point" else (None, None, None)
        rows.append((u, u % 5, family, bool(u % 4 == 0), ops, targets, *point))
    values = rng.normal(size=(4, 3))
    return rows, values


def test_coefficients_reproduce_the_deflection(spark):
    rows, values = _random_constraints()
    here = F.array(*[F.struct(*[F.lit(float(v)).alias(d) for v, d in zip(x, "epa")]) for x in values])
    df = spark.createDataFrame(rows, SCHEMA).withColumn("vec", here)
    coefs = co.quadratic_coefs(df).collect()
    base = {r["unit_id"]: r["deflection"] for r in co.unit_deflection(df).collect()}
    x = 1.7
    for t in range(4):
        for j, d in enumerate("epa"):
            moved = values.copy()
            moved[t, j] = x
            there = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for v, k in zip(row, "epa")]) for row in moved])
            new = {r["unit_id"]: r["deflection"] for r in co.unit_deflection(df.withColumn("vec", there)).collect()}
            for r in coefs:
                if r["target"] == t and r["dim"] == d:
                    old = values[t, j]
                    change = r["c0"] * (x * x - old * old) + r["c1"] * (x - old)
                    assert new[r["unit_id"]] - base[r["unit_id"]] == pytest.approx(change, abs=1e-8)
        break  # one identity is enough: twelve Spark jobs otherwise


def test_chain_arithmetic_equals_columns(spark):
    """Weights used by the sampler equal those from the column coefficients."""
    rows, values = _random_constraints()
    here = F.array(*[F.struct(*[F.lit(float(v)).alias(d) for v, d in zip(x, "epa")]) for x in values])
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for r in co.quadratic_coefs(df.withColumn("vec", here)).collect():
        w = 2 * abs(r["c0"] + 1e-4)
        key = (r["user_id"], r["target"], r["dim"])
        a, b = want.get(key, (0.0, 0.0))
        want[key] = (a + w, b - w * r["c1"] / (2 * r["c0"] + 1e-4))
    got = {}
    by_user = {}
    for r in sentiment.fold_constraints(df).collect():
        by_user.setdefault(r["user_id"], []).append(r)
    for u, rows in by_user.items():
        head, = [r for r in rows if r["target"] < 0]
        user = {"user_id": u}
        for f in head["fixed"] or []:
            key = (u, f["k"] // 3, "epa"[f["k"] % 3])
            got[key] = (f["w"], f["wx"])
        by_target = {}
        for f in rows:
            if f["target"] >= 0:
                by_target.setdefault(f["target"], []).append(f)
        for t, fs in by_target.items():
            seen = pf.Observed(t, fs)
            for j, d in enumerate("epa"):
                w, wx = seen.observe(values, j, 1.0, 1e-4)
                a, b = got.get((user["user_id"], t, d), (0.0, 0.0))
                if w:
                    got[user["user_id"], t, d] = (a + w, b + wx)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-6)


def test_target_twice_is_dropped_and_scored_directly(spark):
    ops = [ident("a", 0), ident("am", 0), word("b", "instruct"), ident("o", 1)]
    df = spark.createDataFrame([(1, 1, "event", False, ops, [0, 1], None, None, None)], SCHEMA).withColumn("vec", vec(TEACHER, STUDENT))
    got = {(r["target"], r["dim"]) for r in co.quadratic_coefs(df).collect()}
    assert (1, "e") in got and (0, "e") not in got
    forms = co.target_forms(df).where("target = 0")
    x = [0.3, -0.2, 0.9]
    value = forms.select(F.expr(co.form_deflection_sql([f"{v}D" for v in x])).alias("q")).first()["q"]
    moved = df.withColumn("vec", vec([v - OFF for v in x], STUDENT))
    assert value == pytest.approx(co.unit_deflection(moved).first()["deflection"], abs=1e-9)


# -- sentences ---------------------------------------------------------------------

IDS = {"teacher": 0, "student": 1, "judge": 2}
Z = {"instruct": 0, "cocky": 1, "aggressive": 2, "be": 3, "have": 4, "go": 5}


def sentence(spark, words, unit=1):
    """words: (form, pos, head[, ptb])."""
    rows = []
    ptbs = {"N": "NN", "V": "VB", "A": "JJ", "D": "DT", "S": "PRP$"}
    for i, (form, pos, head, *rest) in enumerate(words, 1):
        lemma = "be" if form in ("is", "are", "be") else form
        idf = [(form, f"i_{IDS[form]}", IDS[form], None, None, None)] if form in IDS else []
        w = lemma if lemma in Z else None
        v = WORDS.get(w, (0.5, 0.4, 0.3)) if w else ()
        snf = [(w, f"z_{Z[w]}", None, *v)] if w else []
        neg = form in ("not", "don't")
        rows.append((unit, 7, i, head, form, lemma, pos, rest[0] if rest else ptbs.get(pos, "X"), "O", idf, snf, bool(idf) and pos in ("N", "A", "S"), neg))
    form = "array<struct<term:string,id:string,idx:int,e:double,p:double,a:double>>"
    return spark.createDataFrame(
        rows,
        f"unit_id long, user_id long, id int, head int, form string, lemma string, pos string, ptb string, label string, id_forms {form}, sent_forms {form}, mention boolean, negated boolean",
    )


EVERY = cs.ConstraintConfig(isa=True, parent_child=True, clause=True)


def build(spark, words, config=EVERY):
    rows = cs.build_constraints(cs.unit_frames(sentence(spark, words)), config).orderBy("mention_id", "phase", "stage", "part", "sub").collect()
    return [(r["kind"], r["negated"], " ".join(f"{o['role']}:{o['entity']}" for o in r["operands"])) for r in rows]


def test_event_is_made_once(spark):
    got = build(spark, [("teacher", "N", 2), ("instruct", "V", 0), ("student", "N", 2)])
    assert got == [("event", False, "a:i_0 b:z_0 o:i_1")]


def test_event_with_modifiers_and_determiner(spark):
    words = [("aggressive", "A", 2), ("teacher", "N", 3), ("instruct", "V", 0), ("the", "D", 3), ("student", "N", 4), ("cocky", "A", 5)]
    got = build(spark, words)
    assert got == [("event", False, "a:i_0 am:z_2 b:z_0 o:i_1 om:z_1")]


def test_behaviour_with_missing_object_and_missing_actor(spark):
    assert build(spark, [("teacher", "N", 2), ("instruct", "V", 0)])[0] == ("behaviour", False, "a:i_0 b:z_0 o:ZERO")
    assert build(spark, [("instruct", "V", 0), ("teacher", "N", 1)])[0] == ("behaviour", False, "a:ZERO b:z_0 o:i_0")


def test_excluded_verb_makes_no_behaviour(spark):
    kinds = [k for k, *_ in build(spark, [("teacher", "N", 2), ("go", "V", 0), ("have", "V", 1)])]
    assert "behaviour" not in kinds and "event" not in kinds


def test_is_a(spark):
    got = build(spark, [("teacher", "N", 2), ("is", "V", 0), ("cocky", "A", 2)])
    assert got == [("isa", False, "a:i_0 o:z_1")]
    # A comparative is no equality.
    more = build(spark, [("teacher", "N", 2), ("is", "V", 0), ("cocky", "A", 2, "JJR")])
    assert "isa" not in [k for k, *_ in more]
    # Both sides identities: made once.
    both = build(spark, [("teacher", "N", 2), ("is", "V", 0), ("judge", "N", 2)])
    assert [k for k, *_ in both] == ["isa"] and both[0][2] == "a:i_0 o:i_2"


def test_possessive(spark):
    got = build(spark, [("teacher", "S", 0), ("student", "N", 1)])
    kinds = [k for k, *_ in got]
    # The student hangs under a mention, so only the teacher is a root mention.
    assert "possessive" not in kinds
    tokens = sentence(spark, [("teacher", "S", 0), ("student", "N", 1)]).withColumn("mention", F.col("id") == 2)
    rows = cs.build_constraints(cs.unit_frames(tokens), EVERY).collect()
    assert [r["kind"] for r in rows] == ["possessive"]


def test_clause_does_not_block_parent_child(spark):
    got = build(spark, [("aggressive", "A", 2), ("teacher", "N", 0)])
    assert [k for k, *_ in got] == ["clause", "parent_child"]
    assert got[1][2] == "a:i_0 o:z_2"


def test_same_word_on_both_sides(spark):
    plain = build(spark, [("teacher", "N", 2), ("instruct", "V", 0), ("teacher", "N", 2)], cs.ConstraintConfig(behaviours=False, clause=False))
    assert plain == []
    words = [("judge", "N", 2), ("teacher", "N", 3), ("instruct", "V", 0), ("teacher", "N", 3)]
    got = build(spark, words, cs.ConstraintConfig(behaviours=False, clause=False))
    assert got[0] == ("event", False, "a:i_2 b:z_0 o:i_0")


def test_switched_off_kinds_do_not_block(spark):
    words = [("teacher", "N", 2), ("instruct", "V", 0), ("student", "N", 2)]
    kinds = [k for k, *_ in build(spark, words, cs.ConstraintConfig(events=False, behaviours=True, clause=True))]
    assert kinds == ["behaviour", "behaviour"]


def test_every_sentence_switch_changes_rows(spark):
    frames = cs.unit_frames(sentence(spark, [("teacher", "N", 0), ("cocky", "A", 1), ("not", "A", 1)]))
    symbols = spark.createDataFrame(
        [(1, 2, "emoji", 1.5, None, None), (1, 2, "emoticon", -2.5, None, None), (1, 3, "hashtag", 3.5, 0.5, -0.25)],
        "unit_id long, id int, source string, e double, p double, a double",
    )
    scores = spark.createDataFrame([(1, 0.75)], "unit_id long, e double")
    off = dict(events=False, behaviours=False, clause=False, emoji=False)

    def points(**on):
        rows = cs.build_constraints(frames, cs.ConstraintConfig(**{**off, **on}), symbols, scores).collect()
        return [(r["kind"], r["operands"][0]["entity"], r["pe"], r["pp"], r["pa"]) for r in rows]

    assert points(emoji=True) == [("sentence", "i_0", 1.5, None, None)]
    assert points(emoticons=True) == [("sentence", "i_0", -2.5, None, None)]
    assert points(hashtags=True) == [("sentence", "i_0", 3.5, 0.5, -0.25)]
    assert points(lexicon_score=True) == [("sentence", "i_0", 0.75, None, None)]
    assert points(own_words=True) == [("sentence", "i_0", *WORDS["cocky"])]
    assert points(emoji=True, emoticons=True, lexicon_score=True) == [("sentence", "i_0", -2.5, None, None)]
    with pytest.raises(ValueError):
        points()


def test_token_ids_above_a_million(spark):
    words = [("teacher", "N", 2), ("instruct", "V", 0), ("student", "N", 2)]
    near = build(spark, words)
    assert [k for k, *_ in near] == ["event"]
    # Pairs of ids far apart in size stay different pairs.
    far = spark.range(1).select(F.arrays_overlap(cs._pairs(F.lit(1), F.lit(1_000_002)), cs._pairs(F.lit(2), F.lit(2))).alias("x"))
    assert far.first()["x"] is False


def test_neighbour_mix_counts_each_entity_once_per_unit(spark):
    both = [ident("a", 0), word("b", "instruct"), ident("o", 1)]
    rows = [
        (1, 1, "event", False, both, [0, 1], None, None, None),
        (1, 1, "event", False, [*both, word("om", "cocky")], [0, 1], None, None, None),
        (2, 1, "equality", False, [ident("a", 0), ident("o", 2)], [0, 2], None, None, None),
    ]
    values = spark.createDataFrame([(0, 3.0), (1, 0.5)], "idx int, e double")
    got = {r["target"]: r["mean"] for r in evaluate.neighbour_value_mix(spark.createDataFrame(rows, SCHEMA), values).collect()}
    instruct, cocky = 1.85 + OFF, -0.57 + OFF
    # The third identity has no value, so it does not count for the first.
    assert got[0] == pytest.approx((instruct + cocky + 0.5) / 3)
    assert got[1] == pytest.approx((instruct + cocky + 3.0) / 3)
    assert got[2] == pytest.approx(3.0)
