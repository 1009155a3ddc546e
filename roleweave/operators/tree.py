"""Dependency trees.

The nodes of a unit are gathered once into an array sorted by id (ids run from
1), and walks over the tree are array lookups in that row: one shuffle by unit,
none per step.  Depth costs a logarithmic number of pointer doublings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from . import unit_rows
from .matching import NOUN_TAGS, UNIT, is_adjective, is_noun, tagged


def gather(tokens: DataFrame, cols: list[str]) -> DataFrame:
    """One row per unit with ``nodes`` sorted by id."""
    fields = ["id", *[c for c in cols if c != "id"]]
    return tokens.groupBy(UNIT).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("nodes"))


def plain(units: DataFrame, names: list[str], known: str | None = None) -> DataFrame:
    """Units with the named fields of their nodes, sorted by them; ``known`` adds whether a token has such forms."""
    if unit_rows.chained(units):
        n = units.schema["nodes"].dataType.elementType
        types = [*[f"{c}: {n[c].dataType.simpleString()}" for c in names], *(["known: boolean"] if known else [])]
        schema = f"{UNIT} {units.schema[UNIT].dataType.simpleString()}, nodes array<struct<{', '.join(types)}>>"
        return unit_rows.chain(units, unit_rows.plain_step(names, known), schema)

    def shaped(n: Column) -> Column:
        return F.struct(*[n[c].alias(c) for c in names], *([(F.size(n[known]) > 0).alias("known")] if known else []))

    return units.select(UNIT, F.sort_array(F.transform("nodes", shaped)).alias("nodes"))


def node(nodes: Column, at: Column) -> Column:
    """Node by 1-based id; null outside the unit."""
    return F.when(at > 0, F.get(nodes, at - 1))


def _double(start: Column) -> Column:
    """Follow pointers until they no longer move (or 2^rounds steps, on a cycle)."""
    rounds = F.ceil(F.log2(F.size(start) + 1)).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), rounds), start, lambda acc, _: F.transform(acc, lambda x: F.get(acc, x - 1))
    )


def root_array(nodes: Column) -> Column:
    """Per node the id of its root (head 0 or -1); null on a cycle or a broken head."""
    step = F.transform(nodes, lambda n: F.when(n["head"] > 0, n["head"]).otherwise(n["id"]))
    return F.transform(_double(step), lambda r: F.when(F.get(nodes, r - 1)["head"] <= 0, r))


def resolved_array(nodes: Column) -> Column:
    """Per node itself, or for determiners the node reached by first children."""

    def steps(heads: Column) -> Column:
        def step(n: Column) -> Column:
            first = F.array_position(heads, n["id"]).cast("int")
            return F.when((n["pos"] == "D") & (first > 0), first).otherwise(n["id"])

        return F.transform(nodes, step)

    return _double(let(F.transform(nodes, lambda n: n["head"]), steps))


def ancestors(nodes: Column, n: Column) -> Column:
    """Ids above a node, nearest first, each once."""
    none = F.array().cast("array<int>")
    walk = F.aggregate(
        nodes,
        F.struct(n["head"].alias("cur"), none.alias("seen")),
        lambda s, _: F.when(
            (s["cur"] > 0) & ~F.array_contains(s["seen"], s["cur"]),
            F.struct(
                F.coalesce(F.get(nodes, s["cur"] - 1)["head"], F.lit(0)).alias("cur"),
                F.concat(s["seen"], F.array(s["cur"])).alias("seen"),
            ),
        ).otherwise(s),
    )
    return walk["seen"]


def with_roots(tokens: DataFrame) -> DataFrame:
    """Tokens with ``root_id``."""
    frame = gather(tokens, tokens.columns).withColumn("_roots", root_array(F.col("nodes")))
    zipped = F.zip_with("nodes", "_roots", lambda n, r: F.struct(n.alias("n"), r.alias("root_id")))
    rest = [c for c in tokens.columns if c != UNIT]
    return frame.select(UNIT, F.explode(zipped).alias("z")).select(
        UNIT, *[F.col(f"z.n.{c}").alias(c) for c in rest], F.col("z.root_id").alias("root_id")
    )


def children(tokens: DataFrame) -> DataFrame:
    """Head -> ordered child ids."""
    kids = tokens.where(F.col("head") > 0)
    return kids.groupBy(UNIT, F.col("head").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("children"))


def descendants_in(tokens: DataFrame, forms: str) -> DataFrame:
    """(unit, ancestor, id) for every token below, with a known form."""
    return descendants_of(gather(tokens.select(UNIT, "id", "head", (F.size(forms) > 0).alias("known")), ["head", "known"]))


def descendants_of(frame: DataFrame) -> DataFrame:
    """``descendants_in`` of units whose ``nodes`` (id, head, known) are in their row."""
    if unit_rows.chained(frame):
        n = frame.schema["nodes"].dataType.elementType
        schema = f"{UNIT} {frame.schema[UNIT].dataType.simpleString()}, ancestor int, id {n['id'].dataType.simpleString()}"
        return unit_rows.chain(frame, unit_rows.descendants_step(), schema)
    nodes = F.col("nodes")
    pairs = F.transform(nodes, lambda n: F.struct(n["id"].alias("id"), n["known"].alias("known"), ancestors(nodes, n).alias("up")))
    rows = frame.select(UNIT, F.explode(pairs).alias("p")).where("p.known")
    return rows.select(UNIT, F.explode("p.up").alias("ancestor"), F.col("p.id").alias("id"))


def side_children(tokens: DataFrame) -> DataFrame:
    """Children of verbs by side: ``unit, verb, child, resolved, side``."""
    frame = gather(tokens, ["head", "pos"]).withColumn("res", resolved_array(F.col("nodes")))
    rows = frame.select(UNIT, "nodes", F.posexplode("res").alias("i", "resolved"))
    kid = F.get("nodes", F.col("i"))
    verb = node(F.col("nodes"), kid["head"])
    out = rows.select(UNIT, verb.alias("v"), kid["id"].alias("child"), "resolved").where(F.col("v.pos") == "V")
    side = F.when(F.col("resolved") > F.col("v.id"), "right").otherwise("left")
    return out.select(UNIT, F.col("v.id").alias("verb"), "child", "resolved", side.alias("side"))


def modifier_forms(kids: Column, remove: Column) -> tuple[Column, Column]:
    """(identity forms, sentiment forms) of noun and adjective children.

    ``kids`` holds structs with ``pos``, ``idf`` and ``snf``.  A child gives its
    identity forms, or its sentiment forms if no identity form remains.
    """
    fit = F.filter(kids, lambda k: is_noun(k["pos"]) | is_adjective(k["pos"]))

    def kept(forms: Column) -> Column:
        return F.filter(forms, lambda f: ~F.array_contains(remove, f["term"]))

    ids = F.array_distinct(F.flatten(F.transform(fit, lambda k: kept(k["idf"]))))
    words = F.flatten(F.transform(F.filter(fit, lambda k: F.size(kept(k["idf"])) == 0), lambda k: kept(k["snf"])))
    return ids, words


def modifiers_of(tokens: DataFrame, remove: list[str]) -> DataFrame:
    """Per token the terms of its modifiers: ``id_mods`` (a set), ``word_mods`` (a list)."""
    return modifiers_in(gather(tokens, ["head", "pos", "id_forms", "sent_forms"]), remove)


def modifiers_in(frame: DataFrame, remove: list[str]) -> DataFrame:
    """``modifiers_of`` of units whose ``nodes`` are in their row."""
    if unit_rows.chained(frame):
        n = frame.schema["nodes"].dataType.elementType
        schema = f"{UNIT} {frame.schema[UNIT].dataType.simpleString()}, id {n['id'].dataType.simpleString()}, id_mods array<string>, word_mods array<string>"
        return unit_rows.chain(frame, unit_rows.modifiers_step(remove, lambda tags: tagged(tags, [*NOUN_TAGS, "A"])), schema)
    rows = frame.select(UNIT, "nodes", F.explode("nodes").alias("n"))
    kids = F.filter("nodes", lambda k: k["head"] == F.col("n.id"))
    shaped = F.transform(kids, lambda k: F.struct(k["pos"].alias("pos"), k["id_forms"].alias("idf"), k["sent_forms"].alias("snf")))
    ids, words = modifier_forms(shaped, F.array(*[F.lit(r) for r in remove]))
    out = rows.select(
        UNIT, F.col("n.id").alias("id"),
        F.sort_array(F.transform(ids, lambda f: f["term"])).alias("id_mods"),
        F.transform(words, lambda f: f["term"]).alias("word_mods"),
    )
    return out.where((F.size("id_mods") > 0) | (F.size("word_mods") > 0))


def head_word(idf: Column, snf: Column) -> tuple[Column, Column, Column]:
    """(is identity, head form, earlier forms): identity lexicon first."""
    is_id = F.size(idf) > 0
    forms = F.when(is_id, idf).otherwise(snf)
    earlier = F.when(F.size(forms) > 1, F.slice(forms, F.lit(1), F.size(forms) - 1)).otherwise(F.slice(forms, 1, 0))
    return is_id, F.try_element_at(forms, F.lit(-1)), earlier


def head_word_and_modifiers(tokens: DataFrame) -> DataFrame:
    """Head term and earlier terms of each matched token."""
    is_id, head, earlier = head_word(F.col("id_forms"), F.col("sent_forms"))
    out = tokens.where((F.size("id_forms") > 0) | (F.size("sent_forms") > 0))
    return out.select(
        UNIT, "id", is_id.alias("is_identity"), head["term"].alias("head_term"),
        F.transform(earlier, lambda f: f["term"]).alias("earlier"),
    )
