"""Proofs: predictive models and held-out evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import aggregates as ag
from ..operators import coefficients as co
from ..operators import constraints as cs
from ..operators import users
from ..operators.ranking import split_train_test, stable_index, top_k
from ..plans import evaluate, predict
from . import algebra, frames, units
from .base import proof
from .lexicon import rounded
from .relational import SPLIT_SQL, brand_mentions, split_events

# Train and test mentions of brands by suppliers: every seventh part is held out.
BRAND_SQL = """bm AS (SELECT l_suppkey AS user_id, p_brand AS identity, CASE WHEN l_partkey % 7 = 0 THEN 'test' ELSE 'train' END AS split
  FROM lineitem JOIN part ON p_partkey = l_partkey),
vocab AS (SELECT identity, CAST(row_number() OVER (ORDER BY md5(identity)) - 1 AS INT) AS idx FROM (SELECT DISTINCT identity FROM bm)),
k AS (SELECT count(*) AS k FROM vocab),
cnt AS (SELECT user_id, idx, count(*) FILTER (split='train') AS tr, count(*) FILTER (split='test') AS te FROM bm JOIN vocab USING (identity) GROUP BY ALL),
grid AS (SELECT u.user_id, v.idx, coalesce(tr, 0) AS tr, coalesce(te, 0) AS te FROM (SELECT DISTINCT user_id FROM bm) u, vocab v
   LEFT JOIN cnt c ON c.user_id = u.user_id AND c.idx = v.idx),
gl AS (SELECT idx, sum(tr) / (SELECT sum(tr) FROM grid) AS p FROM grid GROUP BY idx),
usr AS (SELECT user_id, idx, tr, te, (tr + 1) / (sum(tr) OVER (PARTITION BY user_id) + (SELECT k FROM k)) AS p FROM grid)"""


def brand_counts(spark, d):
    m = brand_mentions(spark, d).withColumn("split", F.when(F.col("p_partkey") % 7 == 0, "test").otherwise("train"))
    vocab = frames.kept("brand_vocab", spark, d, lambda: stable_index(m, "identity"))
    return users.count_matrix(m, vocab), vocab.select(F.max("idx") + 1).scalar()


def brand_vectors(spark, d):
    counts, k = brand_counts(spark, d)
    return predict.smoothed_user_multinomial(users.count_vectors(counts, k))


@proof("global_multinomial", "M1", "WITH " + BRAND_SQL + " SELECT idx, round(p, 9) AS p FROM gl WHERE p > 0")
def global_multinomial(spark, d):
    counts, _ = brand_counts(spark, d)
    return rounded(predict.global_multinomial(counts.where("split = 'train'")), ["p"], 9)


@proof("smoothed_user_multinomial", "M2", "WITH " + BRAND_SQL + " SELECT user_id, idx, round(p, 9) AS p FROM usr")
def smoothed_user_multinomial(spark, d):
    v = brand_vectors(spark, d).select("user_id", F.posexplode("p").alias("idx", "p"))
    return rounded(v, ["p"], 9)


@proof("global_heldout_loglik", "E1", "WITH " + BRAND_SQL + " SELECT round(sum(CASE WHEN p > 0 THEN te * ln(p) END), 3) AS log_lik, CAST(sum(te) AS BIGINT) AS n_obs, CAST(sum(CASE WHEN p > 0 THEN 0 ELSE te END) AS BIGINT) AS n_missed FROM grid LEFT JOIN gl USING (idx) WHERE te > 0")
def global_heldout_loglik(spark, d):
    counts, _ = brand_counts(spark, d)
    model = predict.global_multinomial(counts.where("split = 'train'"))
    return rounded(evaluate.assoc_heldout_loglik(counts.where("split = 'test'"), model), ["log_lik"], 3)


@proof("user_heldout_loglik", "E1 A14", "WITH " + BRAND_SQL + " SELECT user_id, round(sum(te * ln(p)), 5) AS log_lik, CAST(sum(te) AS DOUBLE) AS n_obs FROM usr GROUP BY 1")
def user_heldout_loglik(spark, d):
    return rounded(evaluate.user_loglik(brand_vectors(spark, d)), ["log_lik"], 5)


@proof("pooled_log_prob", "A14 E5", "WITH " + BRAND_SQL + " SELECT 'user_assoc' AS model, round(sum(te * ln(p))/sum(te), 6) AS log_lik, CAST(sum(te) AS DOUBLE) AS n_obs FROM usr")
def pooled_log_prob(spark, d):
    per = evaluate.user_loglik(brand_vectors(spark, d)).withColumn("model", F.lit("user_assoc"))
    return rounded(ag.pool_counters(per, ["model"], ["log_lik"]), ["log_lik"], 6)


@proof("multinomial_loglik", "X13 M11", "WITH " + BRAND_SQL + " SELECT user_id, round(lgamma(sum(te) + 1) - sum(lgamma(te + 1)) + sum(te * ln(p)), 4) AS log_lik FROM usr GROUP BY 1")
def multinomial_loglik(spark, d):
    v = predict.log_count_term(brand_vectors(spark, d), "test", "_c")
    ll = F.col("_c") + predict.multinomial_log_lik(F.col("test"), F.col("p"))
    return v.select("user_id", F.round(ll, 4).alias("log_lik"))


@proof("softmax_of_counts", "X11 X12", "WITH " + BRAND_SQL + """,
s AS (SELECT user_id, max(tr) AS m, max(tr) + ln(sum(exp(CAST(tr AS DOUBLE) - mx))) AS lse FROM (SELECT *, max(tr) OVER (PARTITION BY user_id) AS mx FROM grid) GROUP BY user_id)
SELECT user_id, idx, round(exp(tr - lse), 9) AS p, round(lse, 6) AS lse FROM grid JOIN s USING (user_id)""")
def softmax_of_counts(spark, d):
    counts, k = brand_counts(spark, d)
    v = users.count_vectors(counts, k)
    rows = v.select("user_id", stats.log_sum_exp(F.col("train")).alias("lse"), F.posexplode(stats.softmax(F.col("train"))).alias("idx", "p"))
    return rows.select("user_id", "idx", F.round("p", 9).alias("p"), F.round("lse", 6).alias("lse"))


@proof("log_add_and_sub", "X12", """
SELECT event_id, round(value/10 + ln(1 + exp(greatest(user_id/7.0 - value/10, -300))), 6) AS add,
  round(CASE WHEN value/10 <= user_id/7.0 THEN greatest(value/10, user_id/7.0) ELSE value/10 + ln(1 - exp(greatest(user_id/7.0 - value/10, -300))) END, 6) AS sub FROM events""")
def log_add_and_sub(spark, d):
    ev = frames.table(spark, d, "events").select("event_id", (F.col("value") / 10).alias("a"), (F.col("user_id") / 7.0).alias("b"))
    return ev.select(
        "event_id", F.round(stats.log_add(F.col("a"), F.col("b")), 6).alias("add"), F.round(stats.log_sub(F.col("a"), F.col("b")), 6).alias("sub")
    )


@proof("top_identities", "W2", "WITH " + BRAND_SQL + """
SELECT user_id, place, idx FROM (SELECT user_id, idx, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, idx) - 1 AS place FROM usr) WHERE place < 3""")
def top_identities(spark, d):
    v = brand_vectors(spark, d)
    return v.select("user_id", F.posexplode(predict.top_candidates(F.col("p"), 3)).alias("place", "idx"))


@proof("top_counts_per_type", "W2 W4", """
WITH c AS (SELECT p_type, p_partkey, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT p_type, p_partkey, n FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_partkey) AS r FROM c) WHERE r <= 5""")
def top_counts_per_type(spark, d):
    n = brand_mentions(spark, d).groupBy("p_type", "p_partkey").agg(F.count("*").alias("n"))
    return top_k(n, ["p_type"], [F.desc("n"), F.asc("p_partkey")], 5, salt=F.col("p_partkey") % 16)


@proof("association_ranks", "W1 E2", "WITH " + BRAND_SQL + """,
r AS (SELECT user_id, idx, te, p, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, idx) - 1 AS rank FROM usr)
SELECT user_id, idx, te AS n, round(ln(p), 6) AS log_prob, rank FROM r WHERE te > 0""")
def association_ranks(spark, d):
    """Mentions of one user and identity share their score, so they are counted first."""
    v = brand_vectors(spark, d).withColumn("w", predict.log_weights(F.col("p")))
    rows = v.select("user_id", "p", "w", F.posexplode("test").alias("idx", "n")).where("n > 0")
    return rows.select(
        "user_id", "idx", F.col("n").cast("long").alias("n"), F.round(F.log(F.get("p", "idx")), 6).alias("log_prob"),
        predict.true_rank(F.col("w"), F.col("idx")).alias("rank"),
    )


# -- score models on events ----------------------------------------------------------
#
# A mention is a held-out event; its type is the identity and its value gives the
# score; vectors come from the training events.

SENT_SQL = SPLIT_SQL + """,
vocab AS (SELECT event_type, CAST(row_number() OVER (ORDER BY md5(event_type)) - 1 AS INT) AS idx FROM (SELECT DISTINCT event_type FROM events)),
sx AS (SELECT event_id, user_id, idx, split, (value - 50) / 50.0 AS score FROM split JOIN vocab USING (event_type)),
um AS (SELECT user_id, idx, avg(score) AS val FROM sx WHERE split='train' GROUP BY ALL),
gm AS (SELECT idx, coalesce(avg(val), 0) AS val FROM vocab LEFT JOIN um USING (idx) GROUP BY idx),
gv AS (SELECT idx, (val - min(val) OVER ())*2/(max(val) OVER () - min(val) OVER ()) - 1 AS v FROM gm),
uv0 AS (SELECT u.user_id, g.idx, coalesce(um.val, g.val) AS val FROM (SELECT DISTINCT user_id FROM um) u, gm g LEFT JOIN um ON um.user_id=u.user_id AND um.idx=g.idx),
uv AS (SELECT user_id, idx, (val - min(val) OVER w)*2/(max(val) OVER w - min(val) OVER w) - 1 AS v FROM uv0 WINDOW w AS (PARTITION BY user_id)),
cand AS (SELECT s.event_id, s.user_id, s.idx AS truth, g.idx, -abs(g.v - s.score) AS wg, -abs(u.v - s.score) AS wu
   FROM sx s, gv g JOIN uv u ON u.user_id = s.user_id AND u.idx = g.idx WHERE s.split='test'),
prob AS (SELECT *, wg - ln(sum(exp(wg)) OVER w) AS lg, wu - ln(sum(exp(wu)) OVER w) AS lu,
   row_number() OVER (PARTITION BY event_id ORDER BY round(wg, 12) DESC, idx) - 1 AS rg, row_number() OVER (PARTITION BY event_id ORDER BY round(wu, 12) DESC, idx) - 1 AS ru
   FROM cand WINDOW w AS (PARTITION BY event_id)),
tru AS (SELECT event_id, user_id, truth, lg, lu, rg, ru FROM prob WHERE idx = truth)"""


def scored_mentions(spark, d):
    """Held-out mentions with weights of the global and the user score model."""
    s = split_events(spark, d)
    vocab = frames.kept("types", spark, d, lambda: stable_index(frames.table(spark, d, "events"), "event_type"))
    k = vocab.select(F.max("idx") + 1).scalar()
    sx = s.join(vocab, "event_type").select("event_id", "user_id", F.col("idx").cast("int").alias("idx"), "split", ((F.col("value") - 50) / 50.0).alias("score"))
    um = ag.mean_by_key(sx.where("split = 'train'"), ["user_id", "idx"], "score")
    base = predict.vector_of(ag.mean_of_means(um, "idx"), k, "idx", "mean_val")
    uv = predict.user_sent_vectors(um, base, 1.0)
    test = sx.where("split = 'test'").withColumn("gbase", base)
    test = test.withColumn("gvec", predict.rescaled("gbase", 1.0))
    rows = test.join(uv, "user_id")
    snap = lambda w: F.transform(w, lambda x: F.round(x, 12))
    rows = rows.withColumns(
        {"wg": snap(predict.distance_weights(F.col("gvec"), F.col("score"))), "wu": snap(predict.distance_weights(F.col("vec"), F.col("score")))}
    )
    return rows.select("event_id", "user_id", F.col("idx").alias("truth"), "wg", "wu"), k


@proof("score_model_mentions", "M3 J9 J10 W1 E2 X11", "WITH " + SENT_SQL + """
SELECT event_id, truth, 'sent_basic' AS model, round(lg, 6) AS log_prob, CAST(rg AS DOUBLE) AS rank FROM tru
UNION ALL SELECT event_id, truth, 'u_sent', round(lu, 6), ru FROM tru""")
def score_model_mentions(spark, d):
    rows, _ = scored_mentions(spark, d)
    s = evaluate.mention_scores(rows, {"sent_basic": "wg", "u_sent": "wu"}, "truth", ["event_id", "truth"])
    return rounded(s, ["log_prob"])


@proof("scoreboard", "E5 A14 A16", "WITH " + SENT_SQL + """, lng AS (SELECT user_id % 5 AS run, 'sent_basic' AS model, lg AS log_prob, rg AS rank FROM tru UNION ALL SELECT user_id % 5, 'u_sent', lu, ru FROM tru)
SELECT run, model, round(avg(log_prob), 6) AS log_prob, round(avg(rank), 6) AS mean_rank, count(*) AS n_obs FROM lng GROUP BY ALL""")
def scoreboard(spark, d):
    return rounded(board(spark, d), ["log_prob", "mean_rank"])


def board(spark, d):
    rows, _ = scored_mentions(spark, d)
    s = evaluate.mention_scores(rows, {"sent_basic": "wg", "u_sent": "wu"}, "truth", ["user_id"])
    return evaluate.scoreboard(s.withColumn("run", F.col("user_id") % 5), ["run", "model"])


@proof("relative_gains", "A16", "WITH " + SENT_SQL + """, lng AS (SELECT user_id % 5 AS run, avg(rg) AS b, avg(ru) AS o FROM tru GROUP BY 1)
SELECT run, round(abs(o - b)/b, 6) AS gain, round((o - b)/b, 6) AS signed_gain FROM lng""")
def relative_gains(spark, d):
    b = board(spark, d).withColumnRenamed("mean_rank", "rank")
    return rounded(ag.relative_gain(b, "u_sent", "sent_basic", "rank"), ["gain", "signed_gain"])


@proof("mean_rank_by_model", "A16", "WITH " + SENT_SQL + """, lng AS (SELECT user_id % 5 AS run, 'sent_basic' AS model, avg(rg) AS rank FROM tru GROUP BY 1 UNION ALL SELECT user_id % 5, 'u_sent', avg(ru) FROM tru GROUP BY 1)
SELECT model, round(avg(rank), 6) AS mean_rank FROM lng GROUP BY 1""")
def mean_rank_by_model(spark, d):
    return rounded(ag.mean_rank_by_model(board(spark, d).withColumnRenamed("mean_rank", "rank")), ["mean_rank"])


COVER = "event_id % 4 <> 0"


@proof("fallback_scores", "E3 E7", "WITH " + SENT_SQL + """, f AS (SELECT user_id, event_id % 4 <> 0 AS c, lu, ru FROM tru)
SELECT user_id, round(avg(CASE WHEN c THEN lu END), 6) AS log_prob, round(avg(CASE WHEN c THEN ru END), 6) AS mean_rank,
 count(*) FILTER (c) AS n_covered, count(*) FILTER (NOT c) AS n_missed,
 round(avg(CASE WHEN c THEN lu ELSE -ln((SELECT count(*) FROM vocab)) END), 6) AS all_log_prob,
 round(avg(CASE WHEN c THEN ru ELSE (SELECT count(*) FROM vocab) / 2 END), 6) AS all_rank FROM f GROUP BY 1""")
def fallback_scores(spark, d):
    rows, k = scored_mentions(spark, d)
    rows = rows.withColumn("wu", F.when(F.expr(COVER), F.col("wu")))
    s = evaluate.fallback_uniform(evaluate.mention_scores(rows, {"u_sent": "wu"}, "truth", ["user_id"]), k)
    covered = evaluate.covered_only(s, ["user_id"])
    every = evaluate.scoreboard(s, ["user_id"]).select("user_id", F.col("log_prob").alias("all_log_prob"), F.col("mean_rank").alias("all_rank"))
    return rounded(covered.join(every, "user_id"), ["log_prob", "mean_rank", "all_log_prob", "all_rank"])


@proof("combined_ranks", "E4 E3", "WITH " + SENT_SQL + """
, c AS (SELECT p.event_id, p.truth, p.idx, CASE WHEN event_id % 4 <> 0 THEN round(wu, 12) + round(wg, 12) ELSE round(wg, 12) END AS w FROM cand p)
SELECT event_id, truth, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY w DESC, idx) - 1 AS rank FROM c) WHERE idx = truth""")
def combined_ranks(spark, d):
    rows, _ = scored_mentions(spark, d)
    w = evaluate.combined_weights(F.when(F.expr(COVER), F.col("wu")), F.col("wg"))
    return rows.withColumn("w", w).select("event_id", "truth", predict.true_rank(F.col("w"), F.col("truth")).alias("rank"))


# -- deflection model ------------------------------------------------------------------


DEFL_SQL = algebra.EVENTS_SQL + f""",
ev2 AS (SELECT *, has_om AND om <> actor AND om <> object AS use_om FROM ev),
cd AS (SELECT e.*, t.idx AS c FROM ev2 e, types t),
fv AS (SELECT cd.event_id, cd.actor, cd.c, has_am, use_om, vc.e AS xe, vc.p AS xp, vc.a AS xa, vo.e AS ye, vo.p AS yp, vo.a AS ya,
   vm.e AS ne, vm.p AS np, vm.a AS na, ma.e AS me, ma.p AS mp, ma.a AS ma, s*wb.e AS be, s*wb.p AS bp, s*wb.a AS ba
  FROM (SELECT *, CASE WHEN negated THEN -1 ELSE 1 END AS s FROM cd) cd JOIN vals vc ON vc.user_id=cd.user_id AND vc.idx=c
  JOIN vals vo ON vo.user_id=cd.user_id AND vo.idx=object JOIN vals vm ON vm.user_id=cd.user_id AND vm.idx=om JOIN wv ma ON ma.z=am JOIN wv wb ON wb.z=verb),
fx AS (SELECT event_id, actor, c, be, bp, ba,
  {", ".join(f"CASE WHEN has_am THEN {m} ELSE x{x} END AS A{x}" for m, x in zip(algebra._modified_sql(["me", "mp", "ma"], ["xe", "xp", "xa"]), "epa"))},
  {", ".join(f"CASE WHEN use_om THEN {m} ELSE y{x} END AS O{x}" for m, x in zip(algebra._modified_sql(["ne", "np", "na"], ["ye", "yp", "ya"]), "epa"))} FROM fv),
q AS (SELECT event_id, actor, c, {algebra._deflection_sql(['Ae','Ap','Aa','be','bp','ba','Oe','Op','Oa'])} AS q FROM fx),
pr AS (SELECT *, -q - ln(sum(exp(-q)) OVER (PARTITION BY event_id)) AS lp, row_number() OVER (PARTITION BY event_id ORDER BY round(q, 9), c) - 1 AS rank FROM q)"""


@proof("deflection_model_mentions", "M4 J9 E2 W1 C18", "WITH " + DEFL_SQL + " SELECT event_id AS unit_id, actor AS target, round(lp, 5) AS log_prob, CAST(rank AS DOUBLE) AS rank FROM pr WHERE c = actor")
def deflection_model_mentions(spark, d):
    """The actor of every event against all candidates under the user's values."""
    c = algebra.event_constraints(spark, d)
    c = c.withColumn("vec", algebra.vector(F.col("user_id"), F.col("k")))
    forms = co.target_forms(c)
    vectors = frames.kept("event_vectors", spark, d, lambda: c.select("user_id", "vec").dropDuplicates(["user_id"]))
    rows = predict.deflection_weights(c.select("unit_id", "user_id", F.col("actor").alias("target")), forms, vectors)
    rows = rows.withColumn("weights", F.transform("weights", lambda w: F.round(w, 9)))
    s = evaluate.mention_scores(rows, {"our_sent": "weights"}, "target", ["unit_id", "target"])
    return s.select("unit_id", "target", F.round("log_prob", 5).alias("log_prob"), "rank")


@proof("constraint_ablation", "E6 M13 M4 C21", None)
def constraint_ablation(spark, d):
    """Toy fit and held-out scores of all ten constraint configurations on the documents."""
    fr = units.kept_frames(spark, d)
    # A unit id is a document and a run number, so documents are the rank buckets.
    split = split_train_test(fr.select("unit_id", "user_id"), 0.15, order=["unit_id"], bucket=F.floor(F.col("unit_id") / 100000))
    split = frames.kept("unit_split", spark, d, lambda: split)
    ids = frames.identities(spark, d)
    base = ids.agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "e", "p", "a"))), lambda x: F.struct(x["e"].alias("e"), x["p"].alias("p"), x["a"].alias("a")))).scalar()
    size = ids.select(F.count("*")).scalar()
    board = evaluate.config_ablation(fr, split, base, size, cs.ABLATION, frames.symbols(spark, d))
    return rounded(board, ["log_prob", "mean_rank"], 4)


@proof("neighbour_value_mix", "E10", None)
def neighbour_value_mix(spark, d):
    mix = evaluate.unit_value_mix(cs.unit_constraints(units.unit_frames(spark, d), units.ALL), frames.identities(spark, d))
    return rounded(mix, ["mean", "sd"], 5)


@proof("recovered_means", "E9", "WITH " + SENT_SQL + """, t AS (SELECT idx, avg(score) AS tv FROM sx GROUP BY 1)
SELECT round(corr(t.tv, gm.val), 5) AS r, round(avg(abs(t.tv - gm.val)), 6) AS mae FROM t JOIN gm USING (idx)""")
def recovered_means(spark, d):
    s = split_events(spark, d)
    vocab = frames.kept("types", spark, d, lambda: stable_index(frames.table(spark, d, "events"), "event_type"))
    sx = s.join(vocab, "event_type").withColumn("score", (F.col("value") - 50) / 50.0)
    true = sx.groupBy("idx").agg(F.avg("score").alias("true_value"))
    um = ag.mean_by_key(sx.where("split = 'train'"), ["user_id", "idx"], "score")
    got = ag.mean_of_means(um, "idx").withColumnRenamed("mean_val", "inferred")
    out = evaluate.recovery_check(true, got)
    return out.select(F.round("r", 5).alias("r"), F.round("mae", 6).alias("mae"))


@proof("user_constraint_split", "U2 C17", algebra.PREPARED + ", " + SPLIT_SQL + """
SELECT c.user_id, c.target, c.dim, s.split, count(*) AS n, round(sum(c.c0), 9) AS c0, round(sum(c.c1), 9) AS c1
FROM coefs c JOIN split s ON s.event_id = c.unit_id GROUP BY ALL""")
def user_constraint_split(spark, d):
    split = split_events(spark, d).select(F.col("event_id").alias("unit_id"), "split")
    c = users.user_constraints(algebra.user_coefs(spark, d), split)
    out = c.groupBy("user_id", "target", "dim", "split").agg(F.count("*").alias("n"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    return rounded(out, ["c0", "c1"], 9)
