"""Proofs: constraint algebra on event rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.fixed_values import EVENT_VARS, MODIFIER_VARS
from ..operators import coefficients as co
from ..operators.aggregates import mean_by_key, sum_count_by
from ..plans import pointfit
from . import frames
from .base import proof

# -- stand-in constraints: one event row is one unit ---------------------------
#
# The event type acts on another event type; the verb and modifiers come from
# the JSON property and the event number.  Values of verbs and identities are
# arithmetic; the values of an identity also depend on the user.

EVENTS_SQL = """types AS (SELECT event_type, CAST(row_number() OVER (ORDER BY md5(event_type)) - 1 AS INT) AS idx
  FROM (SELECT DISTINCT event_type FROM events)),
kt AS (SELECT count(*) AS k FROM types),
ev AS (SELECT e.event_id, e.user_id, e.ts, t.idx AS actor, CAST((t.idx + 1 + e.event_id % (k - 1)) % k AS INT) AS object,
    CAST(json_extract_string(e.props, '$.k') AS INT) % 7 AS verb, e.event_id % 10 = 0 AS negated,
    e.event_id % 4 = 0 AS has_am, e.event_id % 3 AS am, e.event_id % 6 = 0 AS has_om,
    CAST((t.idx + 1 + e.event_id % (k - 1) + 1) % k AS INT) AS om
  FROM events e JOIN types t USING (event_type), kt),
vals AS (SELECT user_id, idx, (idx * 7 % 11 - 5) / 4.0 + user_id % 7 / 10.0 AS e, (idx * 5 % 9 - 4) / 3.0 - user_id % 5 / 8.0 AS p,
    (idx * 3 % 8 - 3) / 2.5 + user_id % 3 / 6.0 AS a FROM (SELECT DISTINCT user_id FROM events), types),
wv AS (SELECT z, (z * 5 % 13 - 6) / 3.0 + 0.0001 AS e, (z * 3 % 7 - 3) / 2.0 + 0.0001 AS p, (z * 2 % 5 - 2) / 1.5 + 0.0001 AS a FROM range(7) r(z))"""


def vector(user, k):
    """Values of every identity for a user, as an array column."""
    i = lambda x: x.cast("double")
    return F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda x: F.struct(
            (i(x * 7 % 11 - 5) / 4.0 + i(user % 7) / 10.0).alias("e"),
            (i(x * 5 % 9 - 4) / 3.0 - i(user % 5) / 8.0).alias("p"),
            (i(x * 3 % 8 - 3) / 2.5 + i(user % 3) / 6.0).alias("a"),
        ),
    )


def word(z):
    i = lambda x: x.cast("double")
    return [i(z * 5 % 13 - 6) / 3.0 + 0.0001, i(z * 3 % 7 - 3) / 2.0 + 0.0001, i(z * 2 % 5 - 2) / 1.5 + 0.0001]


def operand(role, idx=None, z=None):
    none = F.lit(None).cast("double")
    values = [none] * 3 if z is None else word(z)
    entity = F.concat(F.lit("i_"), idx.cast("string")) if z is None else F.concat(F.lit("z_"), z.cast("string"))
    return F.struct(
        F.lit(role).alias("role"), entity.alias("entity"),
        (F.lit(None) if idx is None else idx).cast("int").alias("idx"),
        *[v.alias(d) for v, d in zip(values, "epa")],
    )


def event_rows(spark, d):
    from ..operators.ranking import stable_index

    ev = frames.table(spark, d, "events", wide=True)
    types = frames.kept("types", spark, d, lambda: stable_index(ev, "event_type"))
    k = types.select(F.count("*").cast("int")).scalar()
    j = ev.join(types, "event_type").withColumn("_k", k)
    shift = lambda extra: ((F.col("idx") + 1 + F.col("event_id") % (F.col("_k") - 1) + extra) % F.col("_k")).cast("int")
    return j.select(
        "event_id", "user_id", "ts", F.col("idx").cast("int").alias("actor"), shift(0).alias("object"),
        (F.get_json_object("props", "$.k").cast("int") % 7).alias("verb"), (F.col("event_id") % 10 == 0).alias("negated"),
        (F.col("event_id") % 4 == 0).alias("has_am"), (F.col("event_id") % 3).alias("am"),
        (F.col("event_id") % 6 == 0).alias("has_om"), shift(1).alias("om"), F.col("_k").alias("k"),
    )


def event_constraints(spark, d):
    """Constraints in typed form; the object modifier is an identity, so it is a target too."""
    ev = event_rows(spark, d)
    none = F.lit(None).cast("double")
    om_other = (F.col("om") != F.col("actor")) & (F.col("om") != F.col("object")) & F.col("has_om")
    ops = F.array_compact(
        F.array(
            operand("a", F.col("actor")), operand("b", z=F.col("verb")), operand("o", F.col("object")),
            F.when(F.col("has_am"), operand("am", z=F.col("am"))), F.when(om_other, operand("om", F.col("om"))),
        )
    )
    targets = F.array_compact(F.array("actor", "object", F.when(om_other, F.col("om"))))
    return ev.select(
        F.col("event_id").alias("unit_id"), "user_id", F.lit("event").alias("family"), "negated", ops.alias("operands"),
        targets.alias("targets"), none.alias("pe"), none.alias("pp"), none.alias("pa"), "k", "actor", "ts",
    )


# Independent arithmetic of the SQL twin: the deflection is written out as one
# sum of squares and evaluated at 0, 1 and 2 for each target and dimension.
def _poly_sql(terms, names):
    return " + ".join("*".join([f"({c})", *[names[v] for v in vs]]) for c, vs in terms)


def _deflection_sql(cols):
    names = dict(zip(EVENT_VARS, cols))
    return " + ".join(f"pow({names[v]} - ({_poly_sql(t, names)}), 2)" for v, t in zip(EVENT_VARS, co.EVENT_TERMS))


def _modified_sql(mod, ent):
    names = dict(zip(MODIFIER_VARS, [*mod, *ent]))
    return [_poly_sql(t, names) for t in co.MODIFIER_TERMS]


def _prepared_sql():
    """Rows ev x targets x dim x probe with the nine fundamentals."""
    am = _modified_sql(["me", "mp", "ma"], ["xe", "xp", "xa"])
    om = _modified_sql(["ne", "np", "na"], ["ye", "yp", "ya"])
    a_cols = ", ".join(f"CASE WHEN has_am THEN {m} ELSE x{d} END AS A{d}" for m, d in zip(am, "epa"))
    o_cols = ", ".join(f"CASE WHEN use_om THEN {m} ELSE y{d} END AS O{d}" for m, d in zip(om, "epa"))
    over = lambda alias, who, out: ", ".join(
        f"CASE WHEN {who} = target AND dim = '{d}' THEN x ELSE {alias}.{d} END AS {out}{d}" for d in "epa"
    )
    return EVENTS_SQL + f""",
ev2 AS (SELECT *, has_om AND om <> actor AND om <> object AS use_om FROM ev),
tg AS (SELECT ev2.*, unnest(CASE WHEN use_om THEN [actor, object, om] ELSE [actor, object] END) AS target FROM ev2),
pr AS (SELECT tg.*, dim, x FROM tg, (SELECT unnest(['e','p','a']) AS dim), (SELECT unnest([0.0, 1.0, 2.0]) AS x)),
fv AS (SELECT pr.event_id, pr.user_id, target, dim, x, has_am, use_om, negated,
   {over('va', 'actor', 'x')}, {over('vo', 'object', 'y')}, {over('vm', 'om', 'n')},
   ma.e AS me, ma.p AS mp, ma.a AS ma, wb.e * CASE WHEN negated THEN -1 ELSE 1 END AS be,
   wb.p * CASE WHEN negated THEN -1 ELSE 1 END AS bp, wb.a * CASE WHEN negated THEN -1 ELSE 1 END AS ba
  FROM pr JOIN vals va ON va.user_id=pr.user_id AND va.idx=actor JOIN vals vo ON vo.user_id=pr.user_id AND vo.idx=object
  JOIN vals vm ON vm.user_id=pr.user_id AND vm.idx=om JOIN wv ma ON ma.z=am JOIN wv wb ON wb.z=verb),
fx AS (SELECT event_id, user_id, target, dim, x, {a_cols}, be, bp, ba, {o_cols} FROM fv),
df AS (SELECT event_id, user_id, target, dim, x, {_deflection_sql(['Ae','Ap','Aa','be','bp','ba','Oe','Op','Oa'])} AS q FROM fx),
cf AS (SELECT event_id, user_id, target, dim, max(CASE WHEN x=0 THEN q END) AS q0, max(CASE WHEN x=1 THEN q END) AS q1,
   max(CASE WHEN x=2 THEN q END) AS q2 FROM df GROUP BY ALL),
coefs AS (SELECT event_id AS unit_id, user_id, target, dim, (q2 - 2*q1 + q0)/2 AS c0, q1 - q0 - (q2 - 2*q1 + q0)/2 AS c1 FROM cf)"""


PREPARED = "WITH " + _prepared_sql()


def user_coefs(spark, d):
    c = event_constraints(spark, d)
    c = c.withColumn("vec", vector(F.col("user_id"), F.col("k")))
    return co.quadratic_coefs(c)


@proof("event_coefficients", "C14 C17 C19 C12 C13", PREPARED + """
SELECT unit_id, user_id, target, dim, round(c0, 9) AS c0, round(c1, 9) AS c1 FROM coefs""")
def event_coefficients(spark, d):
    return user_coefs(spark, d).select(
        "unit_id", "user_id", "target", "dim", F.round("c0", 9).alias("c0"), F.round("c1", 9).alias("c1")
    )


@proof("event_minimisers", "C20 A1", PREPARED + """
SELECT user_id, target, dim, count(*) AS n, round(sum(-c1/(2*c0)), 3) AS total FROM coefs GROUP BY ALL""")
def event_minimisers(spark, d):
    m = user_coefs(spark, d).withColumn("value", co.minimiser(F.col("c0"), F.col("c1")))
    out = sum_count_by(m, ["user_id", "target", "dim"])
    return out.select("user_id", "target", "dim", "n", F.round("total", 3).alias("total"))


@proof("event_deflections", "C14 C18", PREPARED + f""",
pl AS (SELECT e.*, va.e AS xe, va.p AS xp, va.a AS xa, vo.e AS ye, vo.p AS yp, vo.a AS ya, vm.e AS ne, vm.p AS np, vm.a AS na,
  ma.e AS me, ma.p AS mp, ma.a AS ma, wb.e * CASE WHEN negated THEN -1 ELSE 1 END AS be,
  wb.p * CASE WHEN negated THEN -1 ELSE 1 END AS bp, wb.a * CASE WHEN negated THEN -1 ELSE 1 END AS ba
  FROM ev2 e JOIN vals va ON va.user_id=e.user_id AND va.idx=actor JOIN vals vo ON vo.user_id=e.user_id AND vo.idx=object
  JOIN vals vm ON vm.user_id=e.user_id AND vm.idx=om JOIN wv ma ON ma.z=am JOIN wv wb ON wb.z=verb),
px AS (SELECT event_id, user_id, be, bp, ba,
  {", ".join(f"CASE WHEN has_am THEN {m} ELSE x{d} END AS A{d}" for m, d in zip(_modified_sql(["me", "mp", "ma"], ["xe", "xp", "xa"]), "epa"))},
  {", ".join(f"CASE WHEN use_om THEN {m} ELSE y{d} END AS O{d}" for m, d in zip(_modified_sql(["ne", "np", "na"], ["ye", "yp", "ya"]), "epa"))} FROM pl)
SELECT event_id AS unit_id, user_id, round({_deflection_sql(['Ae','Ap','Aa','be','bp','ba','Oe','Op','Oa'])}, 9) AS deflection FROM px""")
def event_deflections(spark, d):
    c = event_constraints(spark, d).withColumn("vec", vector(F.col("user_id"), F.col("k")))
    return co.unit_deflection(c).select("unit_id", "user_id", F.round("deflection", 9).alias("deflection"))


@proof("equality_deflections", "C15 C13", "WITH " + EVENTS_SQL + """
SELECT event_id, round(pow(va.e + s*w.e, 2) + pow(va.p + s*w.p, 2) + pow(va.a + s*w.a, 2), 9) AS deflection
FROM (SELECT *, CASE WHEN negated THEN 1 ELSE -1 END AS s FROM ev) e JOIN vals va ON va.user_id=e.user_id AND va.idx=actor JOIN wv w ON w.z=verb""")
def equality_deflections(spark, d):
    ev = event_rows(spark, d)
    own = F.get(vector(F.col("user_id"), F.col("k")), F.col("actor"))
    q = co.equality_deflection([own[x] for x in "epa"], word(F.col("verb")), F.col("negated"))
    return ev.select("event_id", F.round(q, 9).alias("deflection"))


@proof("point_deflections", "C16", "WITH " + EVENTS_SQL + """
SELECT event_id, round(pow(va.e - w.e, 2) + pow(va.p - w.p, 2), 9) AS deflection
FROM ev e JOIN vals va ON va.user_id=e.user_id AND va.idx=actor JOIN wv w ON w.z=verb""")
def point_deflections(spark, d):
    ev = event_rows(spark, d)
    own = F.get(vector(F.col("user_id"), F.col("k")), F.col("actor"))
    w = word(F.col("verb"))
    return ev.select("event_id", F.round(co.point_deflection([own[x] for x in "epa"], [w[0], w[1], None]), 9).alias("deflection"))


@proof("averaged_entities", "C11", "WITH " + frames.LEXICONS_SQL + """,
hit AS (SELECT w.doc_id, l.e, l.p, l.a FROM words w JOIN lex l ON l.term = w.w)
SELECT doc_id, round(avg(e), 5) AS e, round(avg(p), 5) AS p, round(avg(a), 5) AS a FROM hit GROUP BY doc_id""")
def averaged_entities(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("\\pL+"), F.lit(0))
    docs = frames.table(spark, d, "documents").select("doc_id", words.alias("ws"))
    values = frames.lexicon(spark, d).select(F.col("term").alias("entity"), "e", "p", "a")
    out = co.average_terms(docs, "doc_id", "ws", values)
    return out.select("doc_id", *[F.round(x, 5).alias(x) for x in "epa"])


@proof("modified_identities", "C12 S6", "WITH " + EVENTS_SQL + f"""
SELECT event_id, {", ".join(f"round({m}, 9) AS {d}" for m, d in zip(_modified_sql(["w.e", "w.p", "w.a"], ["va.e", "va.p", "va.a"]), "epa"))}
FROM ev JOIN vals va ON va.user_id=ev.user_id AND va.idx=actor JOIN wv w ON w.z=am""")
def modified_identities(spark, d):
    ev = event_rows(spark, d)
    own = F.get(vector(F.col("user_id"), F.col("k")), F.col("actor"))
    out = co.modified(word(F.col("am")), [own[x] for x in "epa"])
    return ev.select("event_id", *[F.round(m, 9).alias(x) for m, x in zip(out, "epa")])


@proof("point_fit_first_pass", "M13 A2", PREPARED + """
SELECT user_id, target, dim, round(avg(-c1/(2*c0)), 4) AS val FROM coefs GROUP BY ALL""")
def point_fit_first_pass(spark, d):
    m = user_coefs(spark, d).withColumn("value", co.minimiser(F.col("c0"), F.col("c1")))
    return mean_by_key(m, ["user_id", "target", "dim"]).select("user_id", "target", "dim", F.round("val", 4).alias("val"))


def _two_passes_sql():
    """The first pass under the base values, the second under the user's own first values."""
    one = _prepared_sql()
    for n in "753":
        one = one.replace(f"user_id % {n}", f"0 % {n}")
    two = re.sub(r"\b(fv|fx|df|cf|coefs)\b", r"\g<1>2", one[one.index("fv AS (") :]).replace("JOIN vals ", "JOIN vals2 ")
    own = ", ".join(f"coalesce(f{d}.value, v.{d}) AS {d}" for d in "epa")
    joins = " ".join(f"LEFT JOIN firsts f{d} ON f{d}.user_id = v.user_id AND f{d}.target = v.idx AND f{d}.dim = '{d}'" for d in "epa")
    return f"""WITH {one}, firsts AS (SELECT user_id, target, dim, avg(-c1 / (2 * c0)) AS value FROM coefs WHERE c0 > 0 GROUP BY ALL),
vals2 AS (SELECT v.user_id, v.idx, {own} FROM vals v {joins}), {two}
SELECT user_id, target, dim, round(avg(-c1 / (2 * c0)), 4) AS value FROM coefs2 WHERE c0 > 0 GROUP BY ALL"""


@proof("point_fit_two_passes", "M13 C19", _two_passes_sql())
def point_fit_two_passes(spark, d):
    c = event_constraints(spark, d)
    one = c.select(F.max("k").alias("k")).select(vector(F.lit(0), F.col("k"))).scalar()
    fit = pointfit.point_fit(c, one)
    return fit.select("user_id", "target", "dim", F.round("value", 4).alias("value"))
