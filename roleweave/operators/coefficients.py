"""Deflections and quadratic coefficients of typed constraints.

A constraint row holds ``family`` (event, equality or point), ``negated``, the
array ``operands`` of ``struct<role, entity, idx, e, p, a>`` and, for points,
``pe, pp, pa``.  Roles: ``a`` (actor, or the left side of an equality), ``b``
(verbs), ``o`` (object, or the right side), ``am`` and ``om`` (modifiers).
Words carry their values; identities carry ``idx``, their place in the vector
of values of the user (or of everyone).

Every residual is a sum of products of different variables, so it is affine in
the values of one identity that occurs once.  Two evaluations then give its
coefficients; no symbolic algebra is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import (
    DIMS,
    EVENT_EQUATION,
    EVENT_VARS,
    MODIFIER_EQUATION,
    MODIFIER_VARS,
    equation_terms,
)

ROLES = ("a", "am", "b", "o", "om")
EVENT_TERMS = equation_terms(EVENT_EQUATION, EVENT_VARS)
MODIFIER_TERMS = equation_terms(MODIFIER_EQUATION, MODIFIER_VARS)

OPERAND_TYPE = "struct<role:string,entity:string,idx:int,e:double,p:double,a:double>"


def polynomial(terms: list[tuple[float, list[str]]], value: dict[str, Column]) -> Column:
    """Sum of coefficient times product of variables."""
    total = None
    for coef, names in terms:
        term = F.lit(coef)
        for name in names:
            term = term * value[name]
        total = term if total is None else total + term
    return total


def average_terms(df: DataFrame, key: str, entities: str, values: DataFrame) -> DataFrame:
    """Mean e, p, a over the entities listed per row; ``values(entity, e, p, a)``."""
    rows = df.select(key, F.explode(entities).alias("entity")).join(values, "entity")
    return rows.groupBy(key).agg(*[F.avg(d).alias(d) for d in DIMS])


def modified(mods: list[Column], entity: list[Column]) -> list[Column]:
    """Modifier equation: (mean of modifiers, identity) -> e, p, a."""
    value = dict(zip(MODIFIER_VARS, [*mods, *entity]))
    return [polynomial(t, value) for t in MODIFIER_TERMS]


def event_residuals(f: list[Column]) -> list[Column]:
    """Nine differences between fundamentals and the impression they leave."""
    value = dict(zip(EVENT_VARS, f))
    return [x - polynomial(t, value) for x, t in zip(f, EVENT_TERMS)]


def sum_squares(parts: list[Column]) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return total


def event_deflection(f: list[Column]) -> Column:
    return sum_squares(event_residuals(f))


def equality_deflection(left: list[Column], right: list[Column], negated: Column) -> Column:
    sign = F.when(negated, 1.0).otherwise(-1.0)
    return sum_squares([x + sign * y for x, y in zip(left, right)])


def point_deflection(identity: list[Column], point: list[Column | None]) -> Column:
    """Over the given dimensions only; null dimensions add nothing."""
    parts = [(x - y) * (x - y) for x, y in zip(identity, point) if y is not None]
    total = F.lit(0.0)
    for part in parts:
        total = total + F.coalesce(part, F.lit(0.0))
    return total


def negate(value: Column, negated: Column) -> Column:
    return F.when(negated, -value).otherwise(value)


def minimiser(c0: Column, c1: Column) -> Column:
    return F.when(c0 != 0, -c1 / (2 * c0))


# -- role summaries -----------------------------------------------------------
#
# The expressions below are generated as SQL text from the coefficient tables.


def _poly_sql(terms: list[tuple[float, list[str]]], names: dict[str, str]) -> str:
    return " + ".join("*".join([f"({c}D)", *[names[v] for v in vs]]) for c, vs in terms)


def fill(operands: Column, vec: Column) -> Column:
    """Operands with identity values taken from the vector."""

    def one(op: Column) -> Column:
        got = F.get(vec, op["idx"])
        return F.struct(
            op["role"].alias("role"),
            op["idx"].alias("idx"),
            *[F.coalesce(op[d], got[d]).alias(d) for d in DIMS],
        )

    return F.transform(operands, one)


def _totals_sql(filled: str) -> str:
    """Per role operand count and sums, and whether the head of a side is an
    identity.  Does not depend on the target, so it is found once per constraint."""
    parts = []
    for r in ROLES:
        mine = f"filter(f, o -> o.role = '{r}')"
        sums = ", ".join(f"'{d}', aggregate({mine}, 0D, (s, o) -> s + o.{d})" for d in DIMS)
        parts.append(f"'{r}', named_struct('n', size({mine}), {sums})")
    heads = [f"'{r}_is_id', exists(f, o -> o.role = '{r}' AND o.idx IS NOT NULL)" for r in ("a", "o")]
    return f"transform(array({filled}), f -> named_struct({', '.join([*parts, *heads])}))[0]"


def _hits_sql(filled: str, target: str) -> str:
    """Occurrences of the target per role."""
    return "array(" + ", ".join(f"size(filter({filled}, o -> o.role = '{r}' AND o.idx <=> {target}))" for r in ROLES) + ")"


def _many_sql(hits: str) -> str:
    return "(" + " + ".join(f"{hits}[{i}]" for i in range(len(ROLES))) + " > 1)"


def _means_sql(p: str, x: list[str]) -> dict[str, str]:
    """Mean of each role with the target's values set to x; null if the role is empty."""
    return {
        r + d: f"({p}tot.{r}.{d} + {p}hits[{i}] * ({v} - {p}own.{d})) / nullif({p}tot.{r}.n, 0)"
        for i, r in enumerate(ROLES)
        for d, v in zip(DIMS, x)
    }


def _entities_sql(p: str, negated: str, m: dict[str, str]) -> dict[str, str]:
    """Actor, verb and object values: a head alone, the modifier equation for
    identities, a plain average for words."""
    out = {}
    for head, mods in (("a", "am"), ("o", "om")):
        names = dict(zip(MODIFIER_VARS, [m[mods + d] for d in DIMS] + [m[head + d] for d in DIMS]))
        nh, nm = f"{p}tot.{head}.n", f"{p}tot.{mods}.n"
        for d, terms in zip(DIMS, MODIFIER_TERMS):
            plain = f"({m[head + d]} * {nh} + {m[mods + d]} * {nm}) / nullif({nh} + {nm}, 0)"
            out[head + d] = (
                f"CASE WHEN {nm} = 0 THEN {m[head + d]} WHEN {p}tot.{head}_is_id THEN {_poly_sql(terms, names)} "
                f"ELSE {plain} END"
            )
    for d in DIMS:
        out["b" + d] = f"CASE WHEN {negated} THEN -{m['b' + d]} ELSE {m['b' + d]} END"
    return out


def _residuals_sql(row: str, f: dict[str, str]) -> list[str]:
    """The nine residuals of a constraint from its actor, verb and object values;
    equality and point constraints have three, the others are zero."""
    out = []
    for i, (v, terms) in enumerate(zip(EVENT_VARS, EVENT_TERMS)):
        event = f"{f[v]} - ({_poly_sql(terms, f)})"
        same = point = "0D"
        if i < len(DIMS):
            d = DIMS[i]
            same = f"CASE WHEN {row}negated THEN {f['a' + d]} + {f['o' + d]} ELSE {f['a' + d]} - {f['o' + d]} END"
            point = f"coalesce({f['a' + d]} - {row}p{d}, 0D)"
        out.append(f"CASE {row}family WHEN 'event' THEN {event} WHEN 'equality' THEN {same} ELSE {point} END")
    return out


N_RES = len(EVENT_VARS)


def _add_residuals(rows: DataFrame, out: str, x: list[str]) -> DataFrame:
    """Add residual columns ``out0..out8`` with the target's values set to ``x``.

    Means, entities and residuals are separate projections, so that each value
    is computed once and the generated code stays small.
    """
    keep = rows.columns
    means = _means_sql("_", x)
    rows = rows.selectExpr(*keep, *[f"{v} AS _m{k}" for k, v in means.items()])
    entities = _entities_sql("_", "negated", {k: f"_m{k}" for k in means})
    rows = rows.selectExpr(*keep, *[f"{v} AS _f{k}" for k, v in entities.items()])
    values = _residuals_sql("", {k: f"_f{k}" for k in entities})
    return rows.selectExpr(*keep, *[f"{v} AS {out}{i}" for i, v in enumerate(values)])


def _inline_square_sql(p: str, row: str, x: list[str]) -> str:
    """Sum of squared residuals as one expression, for use inside array functions."""
    means = _means_sql(p, x)
    entities = _entities_sql(p, f"{row}negated", {k: f"m[{i}]" for i, k in enumerate(means)})
    res = _residuals_sql(row, {k: f"v[{i}]" for i, k in enumerate(entities)})
    body = f"aggregate(array({', '.join(res)}), 0D, (s, r) -> s + r * r)"
    inner = f"transform(array(array({', '.join(entities.values())})), v -> {body})[0]"
    return f"transform(array(array({', '.join(means.values())})), m -> {inner})[0]"


def _dot_sql(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{i} * {b}{i}" for i in range(N_RES)) + ")"


def _differences(rows: DataFrame, keep: list[str], tags: list[tuple[str, str, str]]) -> DataFrame:
    """Columns ``out_i = a_i - b_i`` for each (out, a, b)."""
    return rows.selectExpr(*keep, *[f"{a}{i} - {b}{i} AS {out}{i}" for out, a, b in tags for i in range(N_RES)])


def _res(tag: str) -> list[str]:
    return [f"{tag}{i}" for i in range(N_RES)]


def _with_stats(constraints: DataFrame, vec: str) -> DataFrame:
    """One row per constraint and target identity with role summaries."""
    keep = [c for c in constraints.columns if c not in ("operands", "targets", vec)]
    rows = constraints.withColumn("_filled", fill(F.col("operands"), F.col(vec)))
    # Own values are read first: a vector is as long as the identity list, and would be copied for each target.
    own = f"transform(targets, t -> named_struct('target', t, 'own', get({vec}, t))) AS _targets"
    rows = rows.selectExpr(*keep, "_filled", f"{_totals_sql('_filled')} AS _tot", own)
    rows = rows.select(*keep, "_filled", "_tot", F.explode("_targets").alias("_t"))
    rows = rows.select(*keep, "_filled", "_tot", "_t.target", F.col("_t.own").alias("_own"))
    return rows.selectExpr(*keep, "target", "_tot", f"{_hits_sql('_filled', 'target')} AS _hits", "_own")


def constraint_coefs(constraints: DataFrame, vec: str = "vec") -> DataFrame:
    """Per constraint, target and dimension: ``c0, c1, quadratic``.

    ``vec`` is an array column of ``struct<e, p, a>`` with the current values of
    the row's user, in identity order.
    """
    rows = _with_stats(constraints, vec)
    keep = [c for c in rows.columns if c not in ("_tot", "_hits", "_own")] + ["dim"]
    rows = rows.withColumn("dim", F.explode(F.array(*[F.lit(d) for d in DIMS])))

    def probe(x: float) -> list[str]:
        return [f"IF(dim = '{d}', {x}D, _own.{d})" for d in DIMS]

    rows = _add_residuals(_add_residuals(rows, "_r", probe(0.0)), "_s", probe(1.0))
    third = _inline_square_sql("_", "", probe(2.0))
    rows = rows.selectExpr(*keep, *_res("_r"), *_res("_s"), f"CASE WHEN {_many_sql('_hits')} THEN {third} END AS _q2")
    rows = _differences(rows, [*keep, *_res("_r"), "_q2"], [("_d", "_s", "_r")])
    rows = rows.selectExpr(
        *keep, "_q2", f"{_dot_sql('_r', '_r')} AS _q0", f"{_dot_sql('_d', '_d')} AS c0", f"2 * {_dot_sql('_r', '_d')} AS c1"
    )
    # A target that occurs twice may not be quadratic: check a third point.
    ok = "CASE WHEN _q2 IS NULL THEN true ELSE abs(_q2 - (4*c0 + 2*c1 + _q0)) < 1e-9 * (1 + _q2) END"
    return rows.selectExpr(*keep, "c0", "c1", f"{ok} AS quadratic")


def own_zeros(constraints: DataFrame, vec: str = "vec", ids: str = "own_ids") -> DataFrame:
    """Constraints whose identities are counted within the row and have the value 0, so a row is as long as its own list.

    ``ids`` tells the identities of the row; give it to ``quadratic_coefs``.
    """
    named = F.filter(F.transform("operands", lambda o: o["idx"]), lambda i: i.isNotNull())
    rows = constraints.withColumn(ids, F.array_union("targets", named))
    place = lambda i: (F.array_position(F.col(ids), i) - 1).cast("int")
    operands = F.transform("operands", lambda o: o.withField("idx", place(o["idx"])))
    zero = F.struct(*[F.lit(0.0).alias(d) for d in DIMS])
    rows = rows.withColumns({"operands": operands, "targets": F.transform("targets", place)})
    return rows.withColumn(vec, F.transform(ids, lambda i: zero))


def quadratic_coefs(constraints: DataFrame, vec: str = "vec", keys: list[str] | None = None, ids: str | None = None) -> DataFrame:
    """c0, c1 of the sum of a unit's constraints per identity and dimension.

    Rows whose sum is not of degree two are dropped.  ``ids`` is a column with
    the identities of a row, if its targets are counted within the row.
    """
    keys = keys or ["unit_id", "user_id"]
    per = constraint_coefs(constraints, vec)
    if ids:
        per = per.withColumn("target", F.get(ids, F.col("target")))
    sums = per.groupBy(*keys, "target", "dim").agg(
        F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.bool_and("quadratic").alias("_ok")
    )
    return sums.where(F.col("_ok") & (F.col("c0") > 0)).drop("_ok")


def constraint_deflections(constraints: DataFrame, vec: str = "vec") -> DataFrame:
    """Constraints with their ``deflection`` under the row's values."""
    filled = constraints.withColumn("_filled", fill(F.col("operands"), F.col(vec)))
    keep = [c for c in constraints.columns if c != vec]
    none = "named_struct('e', 0D, 'p', 0D, 'a', 0D) AS _own"
    filled = filled.selectExpr(*keep, f"{_totals_sql('_filled')} AS _tot", f"{_hits_sql('_filled', '-1')} AS _hits", none)
    rows = _add_residuals(filled, "_r", ["0D", "0D", "0D"])
    return rows.selectExpr(*keep, f"{_dot_sql('_r', '_r')} AS deflection")


def unit_deflection(constraints: DataFrame, vec: str = "vec", keys: list[str] | None = None) -> DataFrame:
    """Sum of all constraints of a unit under the row's values."""
    keys = keys or ["unit_id", "user_id"]
    return constraint_deflections(constraints, vec).groupBy(*keys).agg(F.sum("deflection").alias("deflection"))


# -- deflection as a function of the target's three values ---------------------

FORM_PAIRS = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]
FORM = [f"q{i}{j}" for i, j in FORM_PAIRS] + ["l0", "l1", "l2", "k"]


def target_forms(constraints: DataFrame, vec: str = "vec", keys: list[str] | None = None) -> DataFrame:
    """Per unit and target: the deflection of the unit's constraints that hold it,
    as ten numbers of a quadratic form in the target's values, plus the rare
    constraints that hold the target twice, kept whole in ``extra``.

    The form is additive, so sums combine before the shuffle.  Constraints
    without the target add the same to every candidate and cancel.
    """
    keys = keys or ["unit_id", "user_id"]
    rows = _with_stats(constraints, vec)
    rows = _add_residuals(rows, "_r", ["0D", "0D", "0D"])
    for i in range(3):
        rows = _add_residuals(rows, f"_h{i}_", ["1D" if j == i else "0D" for j in range(3)])
    keep = [*keys, "target", "family", "negated", "pe", "pp", "pa", "_tot", "_hits", "_own"]
    rows = _differences(rows, [*keep, *_res("_r")], [(f"_g{i}_", f"_h{i}_", "_r") for i in range(3)])
    many = _many_sql("_hits")
    quad = [_dot_sql(f"_g{i}_", f"_g{j}_") + ("" if i == j else " * 2") for i, j in FORM_PAIRS]
    parts = [*quad, *[f"2 * {_dot_sql('_r', f'_g{i}_')}" for i in range(3)], _dot_sql("_r", "_r")]
    rows = rows.selectExpr(*keep, f"{many} AS _many", *[f"IF({many}, 0D, {x}) AS {n}" for n, x in zip(FORM, parts)])
    whole = F.struct(*["family", "negated", "pe", "pp", "pa"], *[F.col(f"_{c}").alias(c) for c in ("tot", "hits", "own")])
    extra = F.collect_list(F.when(F.col("_many"), whole)).alias("extra")
    return rows.groupBy(*keys, "target").agg(*[F.sum(n).alias(n) for n in FORM], extra)


def form_deflection_sql(x: list[str]) -> str:
    """Deflection of a target form (columns ``FORM`` and ``extra``) at the values ``x``."""
    total = ["k"] + [f"q{i}{j} * {x[i]} * {x[j]}" for i, j in FORM_PAIRS] + [f"l{i} * {x[i]}" for i in range(3)]
    extra = f"aggregate(extra, 0D, (acc, c) -> acc + {_inline_square_sql('c.', 'c.', x)})"
    return f"({' + '.join(total)}) + IF(size(extra) = 0, 0D, {extra})"
