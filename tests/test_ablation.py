"""Scores of forms in blocks of a user, and what is carried past the targets of a constraint."""

import random
import re

from pyspark.sql import functions as F

from roleweave.operators import coefficients as co
from roleweave.plans import evaluate, predict

VEC = "array<struct<e:double,p:double,a:double>>"


def test_forms_score_as_their_weights_do(spark):
    draw = random.Random(3)
    # Equal candidates tie; one user has several blocks, one none of its own rows.
    values = [tuple(float(draw.randint(-3, 3)) for _ in range(3)) for _ in range(6)] * 3
    users = spark.createDataFrame([("c", u, values if u else values[::-1]) for u in range(3)], f"config string, user_id int, vec {VEC}")
    rows = [("c", draw.randint(0, 1), i, draw.randint(0, 17), *[draw.uniform(-1, 1) for _ in co.FORM]) for i in range(60)]
    forms = spark.createDataFrame(rows, "config string, user_id int, unit_id int, target int, " + ", ".join(f"{c} double" for c in co.FORM))
    got = predict.scored_forms(forms, users, ["config", "user_id"], block_rows=7)
    whole = forms.withColumn("extra", F.expr("CAST(array() AS array<struct<family:string,negated:boolean,pe:double,pp:double,pa:double>>)"))
    expr = co.form_deflection_sql([f"x.{d}" for d in "epa"]).split(" + IF(size(extra)")[0]
    weighed = whole.join(users, ["config", "user_id"]).withColumn("w", F.expr(f"transform(vec, x -> -({expr}))"))
    want = evaluate.mention_scores(weighed, {"m": "w"}, "target", ["config", "user_id", "unit_id", "target"])
    shown = lambda df: sorted((r["unit_id"], r["user_id"], r["target"], round(r["log_prob"], 9), r["rank"]) for r in df.collect())
    assert len(shown(got)) == 60 and shown(got) == shown(want)


def test_vectors_are_not_copied_to_targets(spark):
    operand = "struct<role:string,entity:string,idx:int,e:double,p:double,a:double>"
    c = spark.createDataFrame(
        [(1, 1, "point", False, 1.0, 0.0, 0.5, [("a", "i_1", 1, None, None, None)], [1], [(0.0, 0.0, 0.0), (1.0, 2.0, 3.0)])],
        f"unit_id int, user_id int, family string, negated boolean, pe double, pp double, pa double, operands array<{operand}>, targets array<int>, vec {VEC}",
    )
    coefs = co.constraint_coefs(c)
    plan = coefs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    generate = next(x for x in plan[::-1] if "Generate explode" in x)
    below = plan[plan.index(generate) + 1]
    assert "Project" in below and not re.search(r"vec#\d+[,\]]", below)
    assert sorted((r["target"], r["dim"], r["c0"], r["c1"]) for r in coefs.collect()) == [(1, "a", 1.0, -1.0), (1, "e", 1.0, -2.0), (1, "p", 1.0, 0.0)]
