"""Units taken through Arrow batches agree with units taken through columns."""

import pytest
from pyspark.sql import functions as F

from roleweave.operators import constraints as cs
from roleweave.operators import matching, tree, unit_rows

NODES = "array<struct<id:int,form:string,lemma:string,pos:string,ptb:string,head:int,label:string,user_id:string>>"
FORM = "term string, id string, idx int, e double, p double, a double"
TEXTS = [
    (1, "the police Officers was not nice cops you guys"), (2, "cops you guys"), (3, "nice İstanbul cops"), (None, "cops cops nice"),
    (1, "nice the police nice cops"), (5, "the police the police officers no cops guys you guys"),
]


@pytest.fixture
def units(spark):
    tags = ["N", "^", "A", "D", "V", "S"]
    node = lambda i, w: (i, w, "be" if w == "was" else w.lower(), tags[(len(w) + i) % 6], "NN" if i % 2 else "VB", i // 2 if i % 7 else 0, "O", "u")
    rows = [(u, [node(i, w) for i, w in enumerate(t.split(), 1)]) for u, t in TEXTS]
    return spark.createDataFrame(rows, f"unit_id long, copy {NODES}").repartition(3)


@pytest.fixture
def known(spark, units):
    tokens = units.select(F.explode("copy").alias("n")).select("n.*")
    ids = spark.createDataFrame([("cop", "i_0", 0, 0.1, 0.2, 0.3), ("officer", "i_1", 1, 0.0, 0.0, 0.0), ("guys", "i_2", 2, 1.0, 0.5, 0.1)], FORM)
    lex = spark.createDataFrame([("nice", "z_0", None, 1.0, -2.0, 0.3), ("cops", "z_1", None, 1.0, 1.0, 1.0), ("police", "z_2", None, 2.0, 1.0, 1.0)], FORM)
    vocab = matching.vocabulary(tokens)
    return matching.joint_forms({"id_forms": matching.match_vocabulary(vocab, ids), "sent_forms": matching.match_vocabulary(vocab, lex)})


def both_ways(units, known):
    tokens = units.select("unit_id", F.explode("copy").alias("n")).select("unit_id", "n.*")
    ways = [lambda c: c, unit_rows.same_nodes()]
    return [matching.flag_units(matching.match_units(units, w, tokens, known, 4)) for w in ways]


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize(
    "found",
    [
        matching.unit_tokens,
        matching.root_mention_rows,
        cs.frames_of,
        lambda m: tree.modifiers_in(tree.plain(m, ["id", "head", "pos", "id_forms", "sent_forms"]), ["nice"]),
        lambda m: tree.descendants_of(tree.plain(m, ["id", "head"], "sent_forms")),
    ],
    ids=["tokens", "root_mentions", "frames", "modifiers", "descendants"],
)
def test_both_ways_give_the_same_rows(units, known, found):
    one, two = (found(m) for m in both_ways(units, known))
    assert rows(one) == rows(two) and one.count() > 0


def test_units_are_matched_in_one_step_without_lambdas(units, known):
    text = tree.modifiers_in(tree.plain(both_ways(units, known)[1], ["id", "head", "pos", "id_forms", "sent_forms"]), [])
    text = text._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInArrow") == 1 and "lambdafunction" not in text


def test_kinds_of_tokens_make_the_vocabulary(units):
    tokens = units.select(F.explode("copy").alias("n")).select("n.*")
    kinds = matching.token_kinds(units, unit_rows.same_nodes())
    assert rows(matching.vocabulary(kinds)) == rows(matching.vocabulary(tokens))


def test_phrases_merge_the_same_both_ways(spark, units):
    entries = spark.createDataFrame([(e,) for e in ("the police", "police officers", "you guys", "cops you guys", "cops cops", "the the")], "term string")
    one, two = (matching.merge_units(units, w, entries, blocks=3) for w in (lambda c: c, unit_rows.same_nodes()))
    assert rows(one) == rows(two) and max(r[0] for r in one.select(F.explode("nodes.n_parts")).collect()) > 1


def test_pairs_are_counted_before_they_are_shuffled(units):
    one, two = (matching.pair_counts(units, w, 3) for w in (lambda c: c, unit_rows.same_nodes()))
    assert rows(one) == rows(two)


def test_clauses_are_the_same_both_ways(units, known):
    one, two = (cs.frames_of(m) for m in both_ways(units, known))
    for config in (cs.ConstraintConfig(events=False, behaviours=False, emoji=False, negation=True), cs.PRIOR_RUN):
        assert rows(cs.build_constraints(one, config)) == rows(cs.build_constraints(two, config))
    assert rows(cs.clause_points(one, True)) == rows(cs.clause_points(two, True)) and cs.clause_points(one, True).count() > 0


def test_counts_of_flags_are_the_same_both_ways(units, known):
    one, two = (matching.flag_counts(m, ["negated", "mention"]) for m in both_ways(units, known))
    assert rows(one) == rows(two) and one.where("mention > 0").count() > 0


def test_coefficients_need_no_vector_of_all_identities(units, known):
    from roleweave.operators import coefficients as co

    c = cs.build_constraints(cs.frames_of(both_ways(units, known)[0]), cs.ConstraintConfig(emoji=False, isa=True, parent_child=True))
    zero = F.struct(*[F.lit(0.0).alias(x) for x in "epa"])
    want = co.quadratic_coefs(c.withColumn("vec", F.array_repeat(zero, 3)))
    own = co.own_zeros(c)
    assert rows(co.quadratic_coefs(own, ids="own_ids")) == rows(want) and want.count() > 0
    assert own.where("size(vec) <> size(own_ids) OR size(own_ids) > size(operands)").count() == 0
