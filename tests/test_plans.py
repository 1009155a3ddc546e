"""Physical plans: no cross joins, no row-at-a-time Python, pruned scans."""

import os

import pytest
from pyspark.sql import functions as F

from roleweave.catalog import load_all
from roleweave.operators.lexicon import lexicon_compound
from roleweave.session import materialize

DATA = os.environ.get("ROLEWEAVE_DATA", "/root/testdata/sf0.001")
PROOFS = load_all()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

# Arrow functions are for moments, samplers, kernels and lgamma only.
ARROW = {"M5", "M8", "M9", "M10", "M15", "N1", "N8", "X13", "M12"}
SAMPLE = [
    "baseline_scores", "lexicon_match", "tree_roots", "clause_constraints", "event_coefficients", "deflection_model_mentions",
    "score_model_mentions", "train_test_split", "smoothed_user_multinomial", "scoreboard", "user_cells", "strong_edges",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SAMPLE)
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(PROOFS[name].run(spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text and "MapInPandas" not in text


def test_scan_reads_needed_columns(spark):
    text = plan(PROOFS["order_part_components"].run.__globals__["order_parts"](spark, DATA))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text


def test_text_score_shuffles_sums_only(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    valence = materialize(docs.select(F.col("lang").alias("term"), F.lit(1.0).alias("value")).distinct(), "valence")
    text = plan(lexicon_compound(docs, valence, "doc_id"))
    assert "hashpartitioning(_key" in text and "_probe" not in "".join(x for x in text.splitlines() if "hashpartitioning" in x)


def test_constraints_shuffle_a_unit_once(spark):
    from roleweave.catalog import frames
    from roleweave.operators import constraints as cs

    rows = cs.unit_frames(frames.matched_tokens(spark, DATA))
    text = plan(cs.build_constraints(rows, cs.ConstraintConfig(isa=True, parent_child=True, emoji=False)))
    assert text.count("Exchange hashpartitioning") == 1 and "hashpartitioning(unit_id" in text and "Join" not in text


def test_lexicon_meets_tokens_by_broadcast_of_a_written_table(spark):
    text = plan(PROOFS["user_identity_means"].run(spark, DATA))
    assert "BroadcastHashJoin" in text


def test_every_blueprint_id_is_shown():
    want = {f"S{i}" for i in range(1, 18)} | {f"F{i}" for i in range(1, 16)} | {f"J{i}" for i in range(1, 14)}
    want |= {f"A{i}" for i in range(1, 17)} | {f"W{i}" for i in range(1, 10)} | {f"X{i}" for i in range(1, 20)}
    want |= {f"T{i}" for i in range(1, 16)} | {f"C{i}" for i in range(1, 22)} | {f"U{i}" for i in range(1, 7)}
    want |= {f"M{i}" for i in range(1, 17)} | {f"E{i}" for i in range(1, 11)} | {f"N{i}" for i in range(1, 10)}
    have = {i for p in PROOFS.values() for i in p.ids.split()}
    assert want - have == set()
