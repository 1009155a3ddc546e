"""Held-out evaluation: likelihoods, ranks, fallbacks and scoreboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import coefficients as co
from ..operators import constraints as cs
from ..operators.aggregates import shrunk_mean
from ..operators.filters import filter_min_units
from ..session import materialize
from . import pointfit, predict


def assoc_heldout_loglik(test: DataFrame, model: DataFrame) -> DataFrame:
    """Sum of n_test * log p over all mentions of a global multinomial.

    Mentions of identities that the model has no probability for (unseen in
    training, or p = 0) add nothing to the sum; ``n_obs`` counts them too and
    ``n_missed`` says how many they are.
    """
    joined = test.join(model, "idx", "left")
    known = F.col("p") > 0
    return joined.agg(
        F.sum(F.when(known, F.col("n") * F.log("p"))).alias("log_lik"),
        F.sum("n").alias("n_obs"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_missed"),
    )


def user_loglik(vectors: DataFrame, p: str = "p", test: str = "test") -> DataFrame:
    """Per user the held-out sum of n * log p and the number of mentions."""
    return vectors.select(
        "user_id", predict.multinomial_log_lik(F.col(test), F.col(p)).alias("log_lik"),
        F.aggregate(test, F.lit(0.0), lambda s, x: s + x).alias("n_obs"),
    )


def mention_scores(rows: DataFrame, weights: dict[str, str], truth: str, keys: list[str]) -> DataFrame:
    """Long (keys, model, log_prob, rank) from weight columns; null weights stay null."""
    models = F.array(
        *[
            F.struct(
                F.lit(name).alias("model"),
                predict.true_log_prob(F.col(col), F.col(truth)).alias("log_prob"),
                F.when(F.col(col).isNotNull(), predict.true_rank(F.col(col), F.col(truth))).cast("double").alias("rank"),
            )
            for name, col in weights.items()
        ]
    )
    return rows.select(*keys, F.explode(models).alias("s")).select(*keys, "s.*")


def fallback_uniform(scores: DataFrame, size: Column) -> DataFrame:
    """Uncovered mentions: log(1/K) and rank K/2, with a ``covered`` flag."""
    k = size.cast("double")
    return scores.withColumn("covered", F.col("log_prob").isNotNull()).withColumns(
        {"log_prob": F.coalesce("log_prob", -F.log(k)), "rank": F.coalesce("rank", k / 2)}
    )


def combined_weights(sent: Column, assoc: Column) -> Column:
    """Product of both models; the association model alone where the other is missing."""
    both = F.zip_with(sent, assoc, lambda a, b: a + b)
    return F.when(sent.isNotNull(), both).otherwise(assoc)


def scoreboard(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean log probability and mean rank per key (iteration, model, ...)."""
    return scores.groupBy(*keys).agg(
        F.avg("log_prob").alias("log_prob"), F.avg("rank").alias("mean_rank"), F.count("*").alias("n_obs")
    )


def covered_only(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Log probability and rank on covered mentions, with the number missed."""
    hit = F.col("covered")
    return scores.groupBy(*keys).agg(
        F.avg(F.when(hit, F.col("log_prob"))).alias("log_prob"), F.avg(F.when(hit, F.col("rank"))).alias("mean_rank"),
        F.count_if(hit).alias("n_covered"), F.count_if(~hit).alias("n_missed"),
    )


def neighbour_value_mix(constraints: DataFrame, identity_values: DataFrame, user: str = "user_id") -> DataFrame:
    """Per identity: mean and spread over users of the mean e of what it meets in its constraints.

    Words and other identities (``identity_values``: idx, e) count once per
    unit, however many of its constraints hold them; those without a value do
    not count.
    """
    units = constraints.groupBy("unit_id", user).agg(F.collect_list(F.struct("targets", "operands")).alias("constraints"))
    return unit_value_mix(units, identity_values, user)


def unit_value_mix(units: DataFrame, identity_values: DataFrame, user: str = "user_id") -> DataFrame:
    """``neighbour_value_mix`` of units that have their constraints as an array in their row."""

    def met(c: Column) -> Column:
        def by_target(t: Column) -> Column:
            others = F.filter(c["operands"], lambda o: (o["entity"] != "ZERO") & (o["idx"].isNull() | (o["idx"] != t)))
            return F.transform(others, lambda o: F.struct(t.alias("target"), o["entity"].alias("entity"), o["idx"].alias("idx"), o["e"].alias("_word")))

        return F.flatten(F.transform(c["targets"], by_target))

    rows = units.select(user, F.explode(F.array_distinct(F.flatten(F.transform("constraints", met)))).alias("m")).select(user, "m.*")
    valued = rows.join(identity_values.select("idx", F.col("e").alias("_identity")), "idx", "left")
    per = valued.groupBy(user, "target").agg(F.avg(F.coalesce("_word", "_identity")).alias("v")).where(F.col("v").isNotNull())
    return per.groupBy("target").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("*").alias("n_users"))


def recovery_check(true: DataFrame, inferred: DataFrame, key: str = "idx") -> DataFrame:
    """How well inferred values follow true ones: correlation and mean absolute error."""
    both = true.join(inferred, key)
    return both.agg(F.corr("true_value", "inferred").alias("r"), F.avg(F.abs(F.col("true_value") - F.col("inferred"))).alias("mae"))


def toy_model(constraints: DataFrame, split: DataFrame, base: Column) -> DataFrame:
    """Fit on training units, score held-out mentions: (config, unit_id, user_id, target, model, log_prob, rank).

    All configurations (column ``config``) are fitted in one run, a user of
    each on its own.  Values of a user: own two-pass fit, else the shrunk mean
    over the users of the configuration.
    """
    # Each table is read several times below, so it is written once.
    tagged = constraints.join(split.select("unit_id", "split"), "unit_id")
    tagged = tagged.withColumn("user_id", F.struct("config", "user_id")).drop("config")
    tagged = materialize(tagged, "constraints", ["split"])
    train, test = tagged.where("split = 'train'"), tagged.where("split = 'test'")
    fit = materialize(pointfit.point_fit(train, base), "fit")
    names = tagged.select("user_id.config").distinct()
    base_long = names.select("config", F.posexplode(base).alias("target", "b")).select("config", "target", "b.*")
    base_long = base_long.unpivot(["config", "target"], list("epa"), "dim", "value")
    means = shrunk_mean(fit.select("user_id.config", "target", "dim", "value"), base_long, ["config", "target", "dim"])
    pooled = materialize(pointfit.user_vectors(means, base, "config"), "pooled")
    vectors = materialize(pointfit.vectors_over(fit, pooled), "vectors")
    forms = materialize(co.target_forms(pointfit.with_config_vectors(test, vectors, pooled), "vec"), "forms")
    flat = lambda df: df.select("user_id.config", "user_id.user_id", *[c for c in df.columns if c != "user_id"])
    plain = flat(forms.where(F.size("extra") == 0))
    users = flat(pointfit.with_config_vectors(forms.select("user_id").distinct(), vectors, pooled))
    keys = ["config", "unit_id", "user_id", "target"]
    scored = predict.scored_forms(plain, users, ["config", "user_id"]).select(*keys, F.lit("our_sent").alias("model"), "log_prob", "rank")
    # A target that is twice in a constraint has no form: every candidate is put in. Narrow rows are shuffled; the vector comes last.
    rows = predict.form_weights(pointfit.with_config_vectors(forms.where(F.size("extra") > 0), vectors, pooled))
    whole = mention_scores(flat(rows), {"our_sent": "weights"}, "target", keys)
    return scored.unionByName(whole)


def config_ablation(
    frames: DataFrame,
    split: DataFrame,
    base: Column,
    size: Column,
    configs: dict[str, cs.ConstraintConfig] = cs.ABLATION,
    symbols: DataFrame | None = None,
    scores: DataFrame | None = None,
    min_units: int = 30,
) -> DataFrame:
    """Scoreboard of the toy model per constraint configuration.

    Users of fewer than ``min_units`` units are left out.  Every held-out
    mention counts; those without a usable constraint get the uniform
    fallback.  Names of equal configurations share one run.
    """
    split = filter_min_units(split, min_units)
    frames = frames.join(split.select("unit_id"), "unit_id", "left_semi")
    mentions = frames.select(
        "unit_id", "user_id",
        F.explode(F.array_distinct(F.transform(F.flatten(F.transform(F.filter("nodes", lambda n: n["mention"]), lambda n: n["idf"])), lambda f: f["idx"]))).alias("target"),
    ).join(split.where("split = 'test'").select("unit_id"), "unit_id", "left_semi")
    names: dict[cs.ConstraintConfig, list[str]] = {}
    for name, config in configs.items():
        names.setdefault(config, []).append(name)
    made = None
    for config, equal in names.items():
        rows = cs.build_constraints(frames, config, symbols, scores).withColumn("config", F.lit(equal[0]))
        made = rows if made is None else made.unionByName(rows)
    mentions = mentions.withColumn("config", F.explode(F.array(*[F.lit(equal[0]) for equal in names.values()])))
    scored = toy_model(made, split, base).drop("model")
    rows = fallback_uniform(mentions.join(scored, ["config", "unit_id", "user_id", "target"], "left"), size)
    board = rows.groupBy("config").agg(
        F.avg("log_prob").alias("log_prob"), F.avg(F.when(F.col("covered"), F.col("rank"))).alias("mean_rank"),
        F.count_if("covered").alias("n_covered"), F.count("*").alias("n_obs"), F.countDistinct("user_id").alias("n_users"),
    )
    all_names = F.create_map(*[x for equal in names.values() for x in (F.lit(equal[0]), F.array(*map(F.lit, equal)))])
    return board.withColumn("config", F.explode(all_names[F.col("config")]))
