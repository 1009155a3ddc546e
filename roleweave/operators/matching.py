"""Token matching against lexicons, phrases, token classes and mentions.

A unit is one text, read from one input row, so windows and arrays per unit are
bounded by that row.  Word-level work is done once per distinct word, before it
meets the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.fixed_values import NEGATION_WORDS, NO_PLURAL
from ..functions.text import split_phrase, strip_plural
from ..session import materialize
from . import phrases, unit_rows

UNIT = "unit_id"

# Coarse tags of the parsed input.
NOUN_TAGS = ["N", "^"]
POSSESSIVE_TAGS = ["S", "Z"]

# Forms of address that are not mentions: word list, words that
# must come before, words that must come after.
ADDRESS_RULES = (
    (("guys",), ("you", "u"), ()),
    (("man", "guys"), (",", "oh"), (",", "oh")),
)


# -- token classes ----------------------------------------------------------


def last_tag(pos: Column) -> Column:
    """Tag of the last part of a merged token."""
    return F.substring_index(pos, " ", -1)


def is_verb(pos: Column) -> Column:
    return last_tag(pos) == "V"


def is_noun(pos: Column) -> Column:
    return last_tag(pos).isin(NOUN_TAGS)


def is_adjective(pos: Column) -> Column:
    return last_tag(pos) == "A"


def is_possessive(pos: Column) -> Column:
    return last_tag(pos).isin(POSSESSIVE_TAGS)


def all_proper(pos: Column) -> Column:
    return pos.rlike(r"\A\^( \^)*\z")


def pos_class(pos: Column, ptb: Column | None = None) -> Column:
    """noun / verb / adjective / possessive / proper / determiner / hashtag / other."""
    out = (
        F.when(all_proper(pos), "proper")
        .when(is_noun(pos), "noun")
        .when(is_verb(pos), "verb")
        .when(is_adjective(pos), "adjective")
        .when(is_possessive(pos), "possessive")
        .when(last_tag(pos) == "D", "determiner")
        .when(last_tag(pos) == "#", "hashtag")
    )
    if ptb is not None:
        out = out.when(ptb.startswith("N"), "noun")
    return out.otherwise("other")


def mention_class(pos: Column, ptb: Column) -> Column:
    return (
        is_noun(pos) | is_adjective(pos) | is_possessive(pos) | (pos == "#") | F.coalesce(ptb.startswith("N"), F.lit(False))
    )


def tagged(values: pa.Array, tags: list[str]) -> np.ndarray:
    """Whether the last tag of distinct tags is one of some."""
    return np.array([v is not None and v.rsplit(" ", 1)[-1] in tags for v in values.to_pylist()], bool)


def mention_tags(pos: pa.Array, ptb: pa.Array) -> np.ndarray:
    """``mention_class`` of columns."""
    (of, tags), (of_ptb, kinds) = unit_rows.coded(pos), unit_rows.coded(ptb)
    fits = tagged(tags, [*NOUN_TAGS, "A", *POSSESSIVE_TAGS]) | unit_rows.among(tags, ["#"])
    return fits[of] | unit_rows.truths(pc.starts_with(kinds, "N"))[of_ptb]


# -- lexicon ladder ---------------------------------------------------------


def vocabulary(tokens: DataFrame) -> DataFrame:
    """Distinct (text, lemma, proper) of the tokens."""
    return tokens.select(
        F.lower("form").alias("text"), F.col("lemma"), all_proper(F.col("pos")).alias("proper")
    ).distinct()


def match_vocabulary(vocab: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Matched forms of every entry of a `vocabulary`.

    Ladder: whole text; text without plural s; for one-word or proper tokens
    the lemma; for phrases every known part, or the parts joined if that is an
    entry.  ``lexicon`` has ``term`` and payload columns, which come along.
    """
    payload = F.struct(*[F.col(c) for c in ["term", *[c for c in lexicon.columns if c != "term"]]])
    lex = lexicon.select(F.col("term").alias("_cand"), payload.alias("_form"))
    parts = split_phrase(F.col("text"))
    single = (F.size(parts) <= 1) | F.col("proper")

    def cand(rung: int, at: Column, sub: int, text: Column) -> Column:
        return F.struct(F.lit(rung).alias("rung"), at.alias("at"), F.lit(sub).alias("sub"), text.alias("cand"))

    zero = F.lit(0)
    whole = F.array(
        cand(0, zero, 0, F.col("text")),
        cand(1, zero, 0, strip_plural(F.col("text"))),
        cand(2, zero, 0, F.when(single, strip_plural(F.col("text"), whole_token=False))),
        cand(3, zero, 0, F.when(single, F.col("lemma"))),
    )
    sub = F.flatten(
        F.transform(
            parts,
            lambda p, i: F.array(cand(4, i, 0, p), cand(4, i, 1, strip_plural(p, whole_token=False))),
        )
    )
    cands = F.concat(whole, F.when(single, F.slice(sub, 1, 0)).otherwise(sub))
    found = (
        vocab.select("*", F.explode(cands).alias("_c"))
        .where(F.col("_c.cand").isNotNull())
        .select("text", "lemma", "proper", F.col("_c.rung"), F.col("_c.at"), F.col("_c.sub"), F.col("_c.cand").alias("_cand"))
        .join(lex, "_cand")
    )
    per_part = found.groupBy("text", "lemma", "proper", "rung", "at").agg(F.min_by("_form", "sub").alias("_form"))
    per_text = per_part.groupBy("text", "lemma", "proper").agg(
        F.min("rung").alias("_best"), F.sort_array(F.collect_list(F.struct("rung", "at", "_form"))).alias("_all")
    )
    forms = F.transform(F.filter("_all", lambda x: x["rung"] == F.col("_best")), lambda x: x["_form"])
    resolved = per_text.select("text", "lemma", "proper", F.array_distinct(forms).alias("forms"))
    joined = resolved.withColumn(
        "_cand", F.when(F.size("forms") > 1, F.array_join(F.transform("forms", lambda f: f["term"]), " "))
    )
    return joined.join(lex, "_cand", "left").select(
        "text", "lemma", "proper",
        F.when(F.col("_form").isNotNull(), F.array("_form")).otherwise(F.col("forms")).alias("forms"),
    )


def match_lexicon(tokens: DataFrame, matched: DataFrame, out: str = "forms") -> DataFrame:
    """Add matched forms to tokens; empty array where nothing matches."""
    m = matched.select(
        F.col("text").alias("_t"), F.col("lemma").alias("_l"), F.col("proper").alias("_p"), F.col("forms").alias(out)
    )
    on = (
        (F.lower("form") == F.col("_t"))
        & F.col("lemma").eqNullSafe(F.col("_l"))
        & (all_proper(F.col("pos")) == F.col("_p"))
    )
    joined = tokens.join(m, on, "left").drop("_t", "_l", "_p")
    empty = F.slice(F.array(F.lit(None).cast(m.schema[out].dataType.elementType)), 1, 0)
    return joined.withColumn(out, F.coalesce(F.col(out), empty))


# -- units as rows ------------------------------------------------------------
#
# Words of a unit travel as plain arrays and only its hits carry forms; tokens
# are built in the row, so no token is shuffled with its columns.  ``units`` has
# a unit's words as ``copy`` and ``nodes_of`` gives its tokens; a unit that
# comes in several rows has the tokens of all of them, sorted.

KEY = ["text", "lemma", "proper"]


def joint_forms(matched: dict[str, DataFrame]) -> DataFrame:
    """One table of the forms of several lexicons: key and a column for each; null where nothing matches."""
    parts = []
    for name, df in matched.items():
        cols = [F.col("forms") if c == name else F.lit(None).cast(matched[c].schema["forms"].dataType) for c in matched]
        parts.append(df.select(*KEY, *[v.alias(c) for v, c in zip(cols, matched, strict=True)]))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*KEY).agg(*[F.first(c, ignorenulls=True).alias(c) for c in matched])


def by_unit(units: DataFrame, hits: DataFrame) -> DataFrame:
    """(unit, copies, hits) from rows of both kinds; ``hits`` has the unit and ``hit``."""
    one = units.select(UNIT, "copy", F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"))
    two = hits.select(UNIT, F.lit(None).cast(units.schema["copy"].dataType).alias("copy"), "hit")
    # Dealt before they are grouped: hits then travel in the order of their words, which packs well.
    rows = one.unionByName(two).repartition(F.col(UNIT))
    lists = rows.groupBy(UNIT).agg(F.collect_list("copy").alias("copies"), F.collect_list("hit").alias("hits"))
    return lists.where(F.size("copies") > 0)


def _nodes(copies: Column, nodes_of) -> Column:
    return F.sort_array(F.flatten(F.transform(copies, nodes_of)))


def _key(form: Column, lemma: Column, pos: Column) -> Column:
    """What is looked up of a token, as one string: lower-case text, lemma and whether it is proper; null where nothing can match."""
    return _joined_key(F.lower(form), lemma, all_proper(pos))


def _joined_key(text: Column, lemma: Column, proper: Column) -> Column:
    # The length tells where the text ends, the last sign is the flag.
    second = F.when(lemma == text, "=").otherwise(F.coalesce(F.concat(F.lit("+"), lemma), F.lit("-")))
    return F.concat(F.length(text).cast("string"), F.lit(":"), text, second, F.when(proper, "1").when(~proper, "0"))


def _blocks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def match_units(
    units: DataFrame, nodes_of, tokens: DataFrame, known: DataFrame, blocks: int | None = None, answers: DataFrame | None = None
) -> DataFrame:
    """(unit, nodes) with the forms of ``joint_forms`` in the tokens; empty arrays where nothing matches.

    ``tokens`` are those of the units as a table; of them the words are looked
    up.  Units are dealt to ``blocks`` by their id, and a block asks for each of
    its words once: what is shuffled are the units' own words, and the forms of
    a block's words, which its task holds while it streams the units.  ``answers``
    are ``block_answers`` that were written for the same units.
    """
    blocks = blocks or _blocks(units)
    if isinstance(nodes_of, unit_rows.Nodes):
        return _match_rows(units, nodes_of, known, blocks, answers)
    names = [c for c in known.columns if c not in KEY]
    block = F.pmod(F.hash(UNIT), F.lit(blocks))
    asked = tokens.select(UNIT, block.alias("block"), _key(F.col("form"), F.col("lemma"), F.col("pos")).alias("key")).where("key IS NOT NULL")
    # Any unit of a block leads what is found to the block's task.
    asked = asked.groupBy("block", "key").agg(F.min(UNIT).alias(UNIT))
    packed = known.select(_joined_key(*[F.col(c) for c in KEY]).alias("key"), F.struct(*names).alias("forms")).where("key IS NOT NULL")
    answers = materialize(asked.join(packed, "key").select(UNIT, "key", "forms"), "answers")
    none = lambda kind: F.lit(None).cast(kind)
    one = answers.select(UNIT, none(units.schema["copy"].dataType).alias("copy"), "key", "forms")
    two = units.where("copy IS NOT NULL").select(UNIT, "copy", none("string").alias("key"), none(answers.schema["forms"].dataType).alias("forms"))
    rows = one.unionByName(two).repartition(blocks, F.col(UNIT)).sortWithinPartitions(F.col("key").isNull(), UNIT)
    keys = F.transform(nodes_of(F.col("copy")), lambda n: _key(n["form"], n["lemma"], n["pos"]))
    kind = lambda c, df: df.schema[c].dataType.simpleString()
    schema = f"{UNIT} {kind(UNIT, units)}, copies array<{kind('copy', units)}>, found array<array<{kind('forms', answers)}>>"
    found = rows.select(UNIT, block.alias("block"), "copy", "key", "forms", keys.alias("keys")).mapInArrow(_attach, schema)

    def filled(n: Column, f: Column) -> Column:
        forms = [F.coalesce(f[c], F.array().cast(known.schema[c].dataType)).alias(c) for c in names]
        return F.struct(n.alias("n"), *forms)

    nodes = F.zip_with("copies", "found", lambda c, f: F.zip_with(nodes_of(c), f, filled))
    return found.select(UNIT, F.sort_array(F.flatten(nodes)).alias("nodes"))


def block_answers(units: DataFrame, nodes_of: unit_rows.Nodes, known: DataFrame, blocks: int) -> DataFrame:
    """(block, key, forms): the forms of the words of each block of units; what a block asks for is found in Arrow."""
    names = [c for c in known.columns if c not in KEY]
    asked = unit_rows.chain(
        units.where("copy IS NOT NULL").select(_block(blocks).alias("block"), "copy"), unit_rows.told_apart(nodes_of, True), "block int, key string"
    )
    forms = F.struct(*[F.coalesce(F.col(c), F.array().cast(known.schema[c].dataType)).alias(c) for c in names])
    packed = known.select(_joined_key(*[F.col(c) for c in KEY]).alias("key"), forms.alias("forms")).where("key IS NOT NULL")
    return asked.where("key IS NOT NULL").select("block", "key").distinct().join(packed, "key").select("block", "key", "forms")


def _block(blocks: int) -> Column:
    return F.pmod(F.hash(UNIT), F.lit(blocks))


def _match_rows(units: DataFrame, nodes_of: unit_rows.Nodes, known: DataFrame, blocks: int, answers: DataFrame | None) -> DataFrame:
    """``match_units`` where tokens are made in Arrow; rows go to the block of their unit."""
    names = [c for c in known.columns if c not in KEY]
    block = _block(blocks)
    units = units.where("copy IS NOT NULL")
    kind = lambda c, df: df.schema[c].dataType.simpleString()
    if answers is None:
        answers = materialize(block_answers(units, nodes_of, known, blocks), "answers")
    none = lambda of: F.lit(None).cast(of)
    one = answers.select(none(kind(UNIT, units)).alias(UNIT), "block", none(units.schema["copy"].dataType).alias("copy"), "key", "forms")
    two = units.select(UNIT, block.alias("block"), "copy", none("string").alias("key"), none(answers.schema["forms"].dataType).alias("forms"))
    rows = one.unionByName(two).repartitionById(blocks, F.col("block")).sortWithinPartitions(F.col("key").isNull(), UNIT)
    token = units.select(nodes_of(F.col("copy")).alias("n")).schema["n"].dataType.elementType.simpleString()
    columns = "".join(f", {c}: {kind(c, known)}" for c in names)
    return unit_rows.chain(rows, unit_rows.matched_step(nodes_of, names), f"{UNIT} {kind(UNIT, units)}, nodes array<struct<n: {token}{columns}>>")


def token_kinds(units: DataFrame, nodes_of: unit_rows.Nodes) -> DataFrame:
    """Tokens (form, lemma, pos) of units, of some millions one of each kind; a ``vocabulary`` asks for no more."""
    token = units.select(nodes_of(F.col("copy")).alias("n")).schema["n"].dataType.elementType
    schema = ", ".join(f"{c} {token[c].dataType.simpleString()}" for c in ("form", "lemma", "pos"))
    return unit_rows.chain(units.where("copy IS NOT NULL").select("copy"), unit_rows.told_apart(nodes_of, False), schema)


def flag_counts(units: DataFrame, flags: list[str]) -> DataFrame:
    """(unit, tokens, flags): numbers of a unit's tokens and of those with a flag."""
    if not unit_rows.chained(units):
        return units.select(UNIT, F.size("nodes").alias("tokens"), *[F.size(F.filter("nodes", lambda n: n[c])).alias(c) for c in flags])
    schema = ", ".join([f"{UNIT} {units.schema[UNIT].dataType.simpleString()}", *[f"{c} int" for c in ("tokens", *flags)]])
    return unit_rows.chain(units, unit_rows.counts_step(flags), schema)


def unit_tokens(units: DataFrame) -> DataFrame:
    """The tokens of units as rows."""
    names = units.schema["nodes"].dataType.elementType.names
    if not unit_rows.chained(units):
        return units.select(UNIT, F.explode("nodes").alias("n")).select(UNIT, "n.*")
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema["nodes"].dataType.elementType]
    return unit_rows.chain(units, unit_rows.tokens_step(names), f"{UNIT} {units.schema[UNIT].dataType.simpleString()}, " + ", ".join(types))


def _attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of a block with the forms of their words; rows are the forms of the block's words, then its units by id."""
    block, parts, forms, held = None, [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = pc.unique(batch["block"]).to_pylist()
        if ids != [block if block is not None else ids[0]]:
            raise RuntimeError("rows of a block were parted")
        block = ids[0]
        n = batch.num_rows - batch["key"].null_count
        if n:
            parts.append(batch.select(["key", "forms"]).slice(0, n))
        units = pa.Table.from_batches([batch.select([UNIT, "copy", "keys"]).slice(n)])
        if units.num_rows:
            if forms is None:
                known = pa.Table.from_batches(parts or [batch.select(["key", "forms"]).slice(0, 0)])
                forms = known["key"].combine_chunks(), known["forms"].combine_chunks()
            units = units if held is None else pa.concat_tables([held, units])
            # The rows of the last unit may go on in the next batch.
            *_, last = starts = _starts(units[UNIT])
            held = units.slice(last)
            if last:
                yield _found(units.slice(0, last), starts[:-1], *forms)
    if held is not None:
        yield _found(held, [0], *forms)


def _starts(ids: pa.ChunkedArray) -> np.ndarray:
    """Where the rows of each unit begin."""
    codes = ids.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))


def _found(units: pa.Table, starts: np.ndarray, key: pa.Array, forms: pa.Array) -> pa.RecordBatch:
    """One row for each unit: its copies, and for each of them the forms of its words."""
    copies, keys = units["copy"].combine_chunks(), units["keys"].combine_chunks()
    words = forms.take(pc.index_in(keys.flatten(), value_set=key))
    ends = pa.array(np.cumsum(np.concatenate([[0], pc.list_value_length(keys).to_numpy()])), pa.int32())
    cuts = pa.array(np.append(starts, units.num_rows), pa.int32())
    found = pa.ListArray.from_arrays(cuts, pa.ListArray.from_arrays(ends, words))
    return pa.RecordBatch.from_arrays(
        [units[UNIT].combine_chunks().take(pa.array(starts)), pa.ListArray.from_arrays(cuts, copies), found], [UNIT, "copies", "found"]
    )


def flag_units(units: DataFrame, rules=ADDRESS_RULES) -> DataFrame:
    """``match_units`` with plain nodes that also tell ``negated``, ``is_address`` and ``mention``."""
    fields = units.schema["nodes"].dataType.elementType["n"].dataType.names
    if unit_rows.chained(units):
        node = units.schema["nodes"].dataType.elementType
        types = [*node["n"].dataType, node["id_forms"], node["sent_forms"]]
        named = ", ".join([f"{f.name}: {f.dataType.simpleString()}" for f in types] + [f"{c}: boolean" for c in ("negated", "is_address", "mention")])
        step = unit_rows.flagged_step(rules, NEGATION_WORDS, NO_PLURAL, mention_tags)
        return unit_rows.chain(units, step, f"{UNIT} {units.schema[UNIT].dataType.simpleString()}, nodes array<struct<{named}>>")

    def flagged(every: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            n = x["n"]
            text = F.lower(n["form"])
            beside = lambda at: F.lower(F.get(every, at)["n"]["form"])
            address = address_form(text, beside(i - 1), beside(i + 1), rules)
            if "n_parts" in fields:
                address = address & (n["n_parts"] == 1)
            mention = (F.size(x["id_forms"]) > 0) & mention_class(n["pos"], n["ptb"]) & ~address
            return F.struct(
                *[n[f].alias(f) for f in fields], x["id_forms"].alias("id_forms"), x["sent_forms"].alias("sent_forms"),
                negation(text).alias("negated"), address.alias("is_address"), mention.alias("mention"),
            )

        return F.transform(every, one)

    return units.select(UNIT, let(F.col("nodes"), flagged).alias("nodes"))


# -- phrases ----------------------------------------------------------------


def phrase_spans(tokens: DataFrame, entries: DataFrame) -> DataFrame:
    """Accepted spans ``(unit, start, len)``: longest at a start, leftmost first.

    ``entries`` holds terms; those of several words, one space apart, are looked for.
    """
    text = F.lower("form")
    after = F.lead(text).over(Window.partitionBy(UNIT).orderBy("id"))
    pairs = tokens.select(UNIT, "id", phrases.pair(text, F.lit(True), after).alias("pair")).where("pair IS NOT NULL")
    words = F.transform(F.split("term", " "), lambda w: F.struct(w.alias("w"), F.lit(True).alias("gap")))
    known = phrases.entry_pairs(entries.select("term").distinct().select("term", words.alias("tokens")))
    places = phrases.standing(pairs.join(known, "pair"), [UNIT], ["term"])
    per_unit = places.groupBy(UNIT).agg(F.collect_list(F.struct("start", "len")).alias("m"))
    return per_unit.select(UNIT, F.explode(phrases.leftmost(F.col("m"))).alias("s")).select(UNIT, "s.start", "s.len")


def merge_phrases(tokens: DataFrame, entries: DataFrame) -> DataFrame:
    """Merge phrase entries into one token and renumber ids and heads from 1.

    The merged head is that of the first part whose head lies outside it.
    """
    rest = [c for c in tokens.columns if c not in (UNIT, *PARTS)]
    nodes = F.sort_array(F.collect_list(F.struct(*PARTS, *rest))).alias("copy")
    merged = merge_units(tokens.groupBy(UNIT).agg(nodes), lambda copy: copy, entries)
    return merged.select(UNIT, F.explode("nodes").alias("n")).select(UNIT, "n.*")


PARTS = ["id", "form", "lemma", "pos", "head"]


def _rows_by_block(units: DataFrame, blocks: int) -> DataFrame:
    """(unit, copy) with the rows of a unit one after the other, in the task of its block."""
    rows = units.where("copy IS NOT NULL").select(UNIT, "copy", _block(blocks).alias("block"))
    return rows.repartitionById(blocks, F.col("block")).sortWithinPartitions(UNIT)


def gathered(units: DataFrame, nodes_of, blocks: int | None = None) -> DataFrame:
    """(unit, nodes): the tokens of units, the copies of a unit together."""
    if isinstance(nodes_of, unit_rows.Nodes):
        rows = _rows_by_block(units, blocks or _blocks(units)).select(UNIT, "copy")
        nodes = units.select(nodes_of(F.col("copy")).alias("n")).schema["n"].dataType.simpleString()
        return unit_rows.chain(rows, unit_rows.gathered_step(nodes_of), f"{UNIT} {units.schema[UNIT].dataType.simpleString()}, nodes {nodes}")
    grouped = units.repartition(F.col(UNIT)).groupBy(UNIT).agg(F.collect_list("copy").alias("copies"))
    return grouped.select(UNIT, _nodes(F.col("copies"), nodes_of).alias("nodes"))


def pair_counts(units: DataFrame, forms_of, blocks: int | None = None) -> DataFrame:
    """(one, two, n): how often words are neighbours; counted in the task of the units before they are shuffled."""
    grouped = gathered(units, forms_of, blocks)
    if unit_rows.chained(grouped):
        counted = unit_rows.chain(grouped, unit_rows.pair_counts_step(), "one string, two string, n long")
    else:
        counted = unit_pairs(units, forms_of).select("one", "two", F.lit(1).cast("long").alias("n"))
    return counted.groupBy("one", "two").agg(F.sum("n").alias("n"))


def unit_pairs(units: DataFrame, forms_of) -> DataFrame:
    """(unit, one, two): neighbouring words of units, the copies of a unit together."""
    grouped = gathered(units, forms_of)
    if unit_rows.chained(grouped):
        return unit_rows.chain(grouped, unit_rows.pairs_step(), f"{UNIT} {units.schema[UNIT].dataType.simpleString()}, one string, two string")
    forms = F.transform("nodes", lambda n: n["form"])
    beside = lambda ws: F.zip_with(ws, F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), lambda a, b: F.struct(a.alias("one"), b.alias("two")))
    rows = grouped.select(UNIT, F.explode(let(forms, beside)).alias("p"))
    return rows.select(UNIT, "p.*").where("two IS NOT NULL")


def merge_units(units: DataFrame, nodes_of, entries: DataFrame, forms_of=None, blocks: int | None = None) -> DataFrame:
    """(unit, nodes): ``merge_phrases`` within the rows of units; only words, pairs and their hits are shuffled.

    ``forms_of`` gives id and form of the tokens alone, where that is cheaper.
    """
    words = F.transform(F.split("term", " "), lambda w: F.struct(w.alias("w"), F.lit(True).alias("gap")))
    known = phrases.entry_pairs(entries.select("term").distinct().select("term", words.alias("tokens")))
    if isinstance(nodes_of, unit_rows.Nodes):
        return _merge_rows(units, nodes_of, known, forms_of or nodes_of, blocks or _blocks(units))
    key = lambda a, b: phrases.pair(F.lower(a), F.lit(True), F.lower(b))
    asked = unit_pairs(units, forms_of or nodes_of).where(F.col(UNIT).isNotNull()).select(UNIT, key(F.col("one"), F.col("two")).alias("pair"))
    # Repeated places of a pair are found again in the unit's row.
    hits = asked.join(known, "pair").select(UNIT, F.struct("pair", "at", "len", "term").alias("hit"))
    grouped = by_unit(units, hits)
    nodes = let(
        F.struct(_nodes(F.col("copies"), nodes_of).alias("nodes"), F.array_distinct("hits").alias("hits")),
        lambda x: _merged_nodes(x["nodes"], x["hits"], F.col(UNIT).isNotNull(), _node_fields(units, nodes_of)),
    )
    return grouped.select(UNIT, nodes.alias("nodes"))


def _merge_rows(units: DataFrame, nodes_of: unit_rows.Nodes, known: DataFrame, forms_of: unit_rows.Nodes, blocks: int) -> DataFrame:
    """``merge_units`` where tokens are made in Arrow: a block asks for each of its pairs once, and its task holds the entries of those."""
    kind = lambda c, df: df.schema[c].dataType.simpleString()
    asked = unit_rows.chain(_rows_by_block(units, blocks), unit_rows.asked_pairs_step(forms_of), "block int, key string").distinct()
    listed = known.groupBy(F.col("pair").alias("key")).agg(F.collect_list(F.struct("at", "len", "term")).alias("hits"))
    answers = materialize(asked.join(listed, "key").select("block", "key", "hits"), "pair_answers")
    none = lambda of: F.lit(None).cast(of)
    one = answers.select(none(kind(UNIT, units)).alias(UNIT), "block", none(units.schema["copy"].dataType).alias("copy"), "key", "hits")
    two = units.where("copy IS NOT NULL").select(UNIT, _block(blocks).alias("block"), "copy", none("string").alias("key"), none(answers.schema["hits"].dataType).alias("hits"))
    rows = one.unionByName(two).repartitionById(blocks, F.col("block")).sortWithinPartitions(F.col("key").isNull(), UNIT)
    token = units.select(nodes_of(F.col("copy")).alias("n")).schema["n"].dataType.elementType
    rest = "".join(f", {f.name}: {f.dataType.simpleString()}" for f in token if f.name not in PARTS)
    nodes = f"array<struct<id: int, form: string, lemma: string, pos: string, head: int, n_parts: int{rest}>>"
    return unit_rows.chain(rows, unit_rows.merged_step(nodes_of), f"{UNIT} {kind(UNIT, units)}, nodes {nodes}")


def _node_fields(units: DataFrame, nodes_of) -> list[str]:
    return units.select(nodes_of(F.col("copy")).alias("n")).schema["n"].dataType.elementType.names


def _spans(nodes: Column, hits: Column) -> Column:
    """Accepted ``struct<start, len>`` of a unit."""

    def places(i: Column) -> Column:
        pair = phrases.pair(F.lower(F.get(nodes, i)["form"]), F.lit(True), F.lower(F.get(nodes, i + 1)["form"]))
        here = lambda p: F.transform(
            F.filter(hits, lambda h: h["pair"] == p),
            lambda h: F.struct((F.get(nodes, i)["id"] - h["at"]).alias("start"), h["len"].alias("len"), h["term"].alias("term")),
        )
        return let(pair, here)

    def standing(found: Column) -> Column:
        return F.filter(F.array_distinct(found), lambda f: F.size(F.filter(found, lambda g: g == f)) == f["len"] - 1)

    steps = F.sequence(F.lit(0), F.size(nodes) - 2)
    found = F.when((F.size(nodes) > 1) & (F.size(hits) > 0), F.flatten(F.transform(steps, places)))
    spans = let(found, lambda f: F.transform(standing(f), lambda p: F.struct(p["start"].alias("start"), p["len"].alias("len"))))
    none = F.array().cast("array<struct<start:int,len:int>>")
    return let(F.coalesce(spans.cast("array<struct<start:int,len:int>>"), none), phrases.leftmost)


def _merged_nodes(nodes: Column, hits: Column, linked: Column, fields: list[str]) -> Column:
    """Nodes of a unit after its phrases were merged; of an unknown unit no heads are known."""
    rest = [c for c in fields if c not in PARTS]

    def grouped(spans: Column) -> Column:
        def place(n: Column) -> Column:
            own = F.filter(spans, lambda s: (s["start"] <= n["id"]) & (n["id"] < s["start"] + s["len"]))
            return F.coalesce(F.get(own, F.lit(0))["start"], n["id"])

        return F.transform(nodes, lambda n: F.struct(n.alias("n"), place(n).alias("g")))

    def headed(every: Column) -> Column:
        def one(x: Column) -> Column:
            n = x["n"]

            def parts(over: Column) -> Column:
                to = F.when(n["head"] > 0, F.coalesce(F.get(over, F.lit(0))["g"], F.lit(-1))).otherwise(n["head"])
                part = F.struct(*[n[c].alias(c) for c in ("id", "form", "lemma", "pos")], to.alias("hg"))
                return F.array_repeat(F.struct(x["g"].alias("g"), part.alias("p"), n.alias("n")), F.greatest(F.size(over), F.lit(1)))

            return let(F.filter(every, lambda y: linked & (y["n"]["id"] == n["head"])), parts)

        return F.flatten(F.transform(every, one))

    def numbered(x: Column) -> Column:
        def one(g: Column, i: Column) -> Column:
            def made(own: Column) -> Column:
                words = lambda c: F.array_join(F.transform(own, lambda y: y["p"][c]), " ")
                h = F.coalesce(F.get(F.filter(own, lambda y: y["p"]["hg"] != g), F.lit(0))["p"]["hg"], F.lit(0))
                at = lambda k: F.when(k > 0, F.nullif(F.array_position(x["groups"], k), F.lit(0)).cast("int")).otherwise(k)
                return F.struct(
                    (i + 1).cast("int").alias("id"), *[words(c).alias(c) for c in ("form", "lemma", "pos")], let(h, at).alias("head"),
                    F.size(own).alias("n_parts"), *[F.get(own, F.lit(0))["n"][c].alias(c) for c in rest],
                )

            own = F.filter(x["every"], lambda y: y["g"] == g)
            return let(F.array_sort(own, lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0)), made)

        return F.transform(x["groups"], one)

    groups = lambda every: F.struct(every.alias("every"), F.sort_array(F.array_distinct(F.transform(every, lambda y: y["g"]))).alias("groups"))
    return let(let(let(let(_spans(nodes, hits), grouped), headed), groups), numbered)


# -- neighbours, mentions, symbols -------------------------------------------


def neighbour_token(tokens: DataFrame, offset: int, col: str = "form", out: str = "neighbour") -> DataFrame:
    """Value of the token ``offset`` places after (before, if negative) in the unit."""
    w = Window.partitionBy(UNIT).orderBy("id")
    value = F.lead(col, offset).over(w) if offset >= 0 else F.lag(col, -offset).over(w)
    return tokens.withColumn(out, value)


def address_form(text: Column, prev: Column, nxt: Column, rules=ADDRESS_RULES) -> Column:
    """Whether a word between its neighbours is a form of address."""
    hit = F.lit(False)
    for words, before, after in rules:
        beside = prev.isin(*before) if before else F.lit(False)
        if after:
            beside = F.coalesce(beside, F.lit(False)) | F.coalesce(nxt.isin(*after), F.lit(False))
        hit = hit | (text.isin(*words) & F.coalesce(beside, F.lit(False)))
    return hit


def exclude_address_forms(tokens: DataFrame, rules=ADDRESS_RULES, out: str = "is_address") -> DataFrame:
    """Flag forms of address: listed words next to listed neighbours."""
    t = neighbour_token(neighbour_token(tokens, -1, out="_prev"), 1, out="_next")
    hit = address_form(*(F.lower(c) for c in ("form", "_prev", "_next")), rules)
    if "n_parts" in tokens.columns:
        hit = hit & (F.col("n_parts") == 1)
    return t.withColumn(out, hit).drop("_prev", "_next")


def identity_mentions(tokens: DataFrame, forms: str = "id_forms") -> DataFrame:
    """Tokens that mention an identity: known form, fitting class, no form of address."""
    cond = (F.size(forms) > 0) & mention_class(F.col("pos"), F.col("ptb")) & ~F.col("is_address")
    return tokens.where(cond)


def unit_identities(mentions: DataFrame, forms: str = "id_forms") -> DataFrame:
    """Distinct identities per unit, nested ones included."""
    ids = mentions.select(UNIT, F.explode(forms).alias("f")).select(UNIT, F.col("f.id").alias("id"))
    return ids.groupBy(UNIT).agg(F.sort_array(F.collect_set("id")).alias("identities"))


def root_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions whose direct head is not a mention."""
    heads = mentions.select(F.col(UNIT), F.col("id").alias("head"))
    return mentions.join(heads, [UNIT, "head"], "left_anti")


def root_mention_rows(units: DataFrame) -> DataFrame:
    """(unit, id, head) of the ``root_mentions`` of units."""
    if not unit_rows.chained(units):
        return units.select(UNIT, F.explode(root_mentions_of(F.col("nodes"))).alias("m")).select(UNIT, "m.id", "m.head")
    node, names = units.schema["nodes"].dataType.elementType, ["id", "head"]
    schema = ", ".join([f"{UNIT} {units.schema[UNIT].dataType.simpleString()}", *[f"{c} {node[c].dataType.simpleString()}" for c in names]])
    return unit_rows.chain(units, unit_rows.selected_step(unit_rows.roots_of_mentions, names), schema)


def root_mentions_of(nodes: Column) -> Column:
    """``root_mentions`` within a unit's row."""

    def kept(mentions: Column) -> Column:
        ids = F.transform(mentions, lambda m: m["id"])
        return let(ids, lambda i: F.filter(mentions, lambda m: ~F.coalesce(F.array_contains(i, m["head"]), F.lit(False))))

    return let(F.filter(nodes, lambda n: n["mention"]), kept)


def negation(text: Column) -> Column:
    """Whether a word is in the negation list."""
    return text.isin(NEGATION_WORDS) | F.coalesce(strip_plural(text).isin(NEGATION_WORDS), F.lit(False))


def negated(tokens: DataFrame, with_children: bool = False, out: str = "negated") -> DataFrame:
    """Flag tokens in the negation list; optionally also tokens with such a child."""
    flagged = tokens.withColumn(out, negation(F.lower("form")))
    if not with_children:
        return flagged
    kids = flagged.where(out).select(UNIT, F.col("head").alias("id")).distinct().withColumn("_k", F.lit(True))
    joined = flagged.join(kids, [UNIT, "id"], "left")
    return joined.withColumn(out, F.col(out) | F.coalesce("_k", F.lit(False))).drop("_k")


def symbol_values(tokens: DataFrame, pattern: str | None, emoji: DataFrame | None, emoticons: DataFrame | None, hashtags: DataFrame | None) -> DataFrame:
    """Values of emoji, emoticons and hashtags: ``unit, id, source, e, p, a``.

    Give tokens that are not mentions.  Emoji are found inside a token by
    ``pattern``; emoticons and hashtags by the ladder of ``match_vocabulary``.
    Emoji and emoticons (``symbol, value``) carry an e only.
    """
    none = F.lit(None).cast("double")
    frames = []

    def lookup(entries: DataFrame, source: str) -> DataFrame:
        found = match_lexicon(tokens, match_vocabulary(vocabulary(tokens), entries), "_forms")
        return found.select(UNIT, "id", F.explode("_forms").alias("f")).select(UNIT, "id", F.lit(source).alias("source"), "f.e", "f.p", "f.a")

    if emoji is not None:
        hits = tokens.select(UNIT, "id", F.explode(F.regexp_extract_all("form", F.lit(pattern), F.lit(0))).alias("symbol"))
        frames.append(hits.join(emoji, "symbol").select(UNIT, "id", F.lit("emoji").alias("source"), F.col("value").alias("e"), none.alias("p"), none.alias("a")))
    if emoticons is not None:
        frames.append(lookup(emoticons.select(F.col("symbol").alias("term"), F.col("value").alias("e"), none.alias("p"), none.alias("a")), "emoticon"))
    if hashtags is not None:
        frames.append(lookup(hashtags.select("term", "e", "p", "a"), "hashtag"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
