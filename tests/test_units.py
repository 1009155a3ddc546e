"""Units matched and merged in their rows agree with token tables and are shuffled once."""

import re

import pytest
from pyspark.sql import functions as F

from roleweave.operators import constraints as cs
from roleweave.operators import matching

TOKEN = "unit_id long, id int, form string, lemma string, pos string, ptb string, head int, label string, user_id string"
NODES = "array<struct<id:int,form:string,lemma:string,pos:string,ptb:string,head:int,label:string,user_id:string>>"


@pytest.fixture
def tokens(spark):
    texts = {1: "The police officers was not nice cops", 2: "cops you guys", 3: "nice", None: "cops cops"}
    rows = [(u, i, w, None if w == "nice" else w.lower(), "^" if w == "cops" else "N", "NN", i // 2, "O", "u") for u, t in texts.items() for i, w in enumerate(t.split(), 1)]
    return spark.createDataFrame(rows, TOKEN)


@pytest.fixture
def known(spark, tokens):
    form = "term string, id string, idx int, e double, p double, a double"
    ids = spark.createDataFrame([("cop", "i_0", 0, 0.1, 0.2, 1 / 3), ("officer", "i_1", 1, 0.0, 0.0, 0.0)], form)
    lex = spark.createDataFrame([("nice", "z_0", None, 1.0001, -2.0001, 0.1 + 0.2), ("cops", "z_1", None, 1.0, 1.0, 1.0)], form)
    vocab = matching.vocabulary(tokens)
    return {"id_forms": matching.match_vocabulary(vocab, ids), "sent_forms": matching.match_vocabulary(vocab, lex)}


def _units(tokens):
    cols = [c for c in tokens.columns if c != "unit_id"]
    return tokens.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).cast(NODES).alias("copy"))


def _flagged(tokens, known):
    return matching.flag_units(matching.match_units(_units(tokens), lambda c: c, tokens, matching.joint_forms(known)))


def test_units_match_as_tokens_do(spark, tokens, known):
    t = matching.exclude_address_forms(matching.negated(tokens))
    for c, m in known.items():
        t = matching.match_lexicon(t, m, c)
    want = t.withColumn("mention", (F.size("id_forms") > 0) & matching.mention_class(F.col("pos"), F.col("ptb")) & ~F.col("is_address"))
    got = _flagged(tokens, known).select("unit_id", F.explode("nodes").alias("n")).select("unit_id", "n.*")
    rows = lambda df: sorted(map(repr, df.select(*sorted(want.columns)).collect()))
    assert rows(got) == rows(want)


def test_a_unit_of_several_rows_has_the_tokens_of_all(spark, tokens, known):
    twice = _units(tokens).unionByName(_units(tokens))
    got = matching.match_units(twice, lambda c: c, tokens.unionByName(tokens), matching.joint_forms(known))
    assert {r["unit_id"]: r["n"] for r in got.select("unit_id", F.size("nodes").alias("n")).collect()} == {1: 14, 2: 6, 3: 2, None: 4}


def test_frames_follow_the_match_without_another_shuffle(spark, tokens, known):
    units = spark.createDataFrame(_units(tokens).collect(), f"unit_id long, copy {NODES}")
    table = matching.joint_forms(known)
    table = spark.createDataFrame(table.collect(), table.schema)
    t = units.select("unit_id", F.explode("copy").alias("n")).select("unit_id", "n.*")
    frames = cs.frames_of(matching.flag_units(matching.match_units(units, lambda c: c, t, F.broadcast(table))))
    plan = frames._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)", plan)
    assert dealt == ["unit_id"]


def test_merging_in_rows_follows_token_tables(spark, tokens):
    entries = spark.createDataFrame([("police officers",), ("the police officers",), ("you guys",), ("cops cops",)], "term string")
    rows = matching.merge_phrases(tokens, entries).orderBy("unit_id", "id").collect()
    assert [(r["unit_id"], r["id"], r["form"], r["head"], r["n_parts"]) for r in rows] == [
        (None, 1, "cops", 0, 1), (None, 2, "cops", -1, 1),
        (1, 1, "The police officers", 0, 3), (1, 2, "was", 1, 1), (1, 3, "not", 1, 1), (1, 4, "nice", 1, 1), (1, 5, "cops", 1, 1),
        (2, 1, "cops", 0, 1), (2, 2, "you guys", 1, 2), (3, 1, "nice", 0, 1),
    ]


def test_words_of_a_block_travel_once(spark, known):
    """What brings the forms to the units grows with the words of a block, not with its tokens."""
    rows = [(u, i, "cops", "cops", "^", "NN", 0, "O", "u") for u in range(200) for i in range(1, 6)]
    t = spark.createDataFrame(rows, TOKEN)
    got = matching.match_units(_units(t), lambda c: c, t, matching.joint_forms(known), blocks=2)
    answers = [f for f in got.inputFiles() if "/answers-" in f]
    assert spark.read.parquet(*answers).count() == 2
    sizes = got.select(F.size(F.filter("nodes", lambda n: F.size("nodes") > 0)).alias("n"), F.size(F.filter("nodes", lambda n: F.size(n["sent_forms"]) > 0)).alias("hit"))
    assert {(r["n"], r["hit"]) for r in sizes.collect()} == {(5, 5)}


def test_rows_of_a_unit_meet_across_batches(spark, tokens, known):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        many = _units(tokens)
        for _ in range(3):
            many = many.unionByName(_units(tokens))
        got = matching.match_units(many, lambda c: c, tokens, matching.joint_forms(known), blocks=1)
        found = {r["unit_id"]: (r["n"], r["hits"]) for r in got.select("unit_id", F.size("nodes").alias("n"), F.size(F.filter("nodes", lambda n: F.size(n["id_forms"]) > 0)).alias("hits")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {1: (28, 8), 2: (12, 4), 3: (4, 0), None: (8, 8)}


def test_nodes_are_made_once_for_the_frames(spark, tokens, known):
    frames = cs.frames_of(matching.flag_units(matching.match_units(_units(tokens), lambda c: c, tokens, matching.joint_forms(known))))
    assert frames._jdf.queryExecution().optimizedPlan().toString().count("zip_with(copies") == 1


def test_blocks_of_units_are_those_of_their_tokens(spark, tokens, tmp_path):
    from roleweave.sources import tokens as tk

    t = tokens.where("unit_id IS NOT NULL").withColumn("lemma", F.coalesce("lemma", "form"))
    tk.write_token_blocks(t, str(tmp_path / "tokens"))
    tk.write_unit_blocks(matching.gathered(_units(t), lambda c: c), str(tmp_path / "units"))
    one, two = (sorted(map(tuple, tk.read_token_blocks(spark, str(tmp_path / p)).collect()), key=repr) for p in ("tokens", "units"))
    assert one == two and len(one) == t.count()
    files = [p for p in (tmp_path / "units").iterdir() if p.name.startswith("part-")]
    assert files and all(p.suffix == ".gz" for p in files)
