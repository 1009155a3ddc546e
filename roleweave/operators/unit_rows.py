"""Units in Arrow batches: tokens of many units as flat columns.

A step is a function from batches to batches.  Steps that follow each other run
in one task over the same buffers, so nodes between them are never built as
rows.  Offsets tell where the tokens of a unit begin; what a token asks of
another one is an index into the same columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

UNIT = "unit_id"

# Tokens that are gathered before their kinds are told apart.
GATHERED = 1 << 21


class Nodes:
    """Tokens of a unit's ``copy``: as a column, and as an array of token structs for an array of copies.

    ``kinds`` gives offsets of the copies and ``token_kinds`` of their tokens, where that is cheaper than the tokens.
    """

    def __init__(self, column, arrow: Callable[[pa.Array], pa.ListArray], kinds=None):
        self.column, self.arrow = column, arrow
        self.kinds = kinds or self._kinds

    def _kinds(self, copies: pa.Array):
        offsets, tokens = flat(self.arrow(copies))
        return offsets, *token_kinds(tokens)

    def __call__(self, copy):
        return self.column(copy)


def same_nodes() -> Nodes:
    """Copies that are tokens already."""
    return Nodes(lambda copy: copy, lambda copies: copies)


def chained(df: DataFrame) -> bool:
    return hasattr(df, "arrow_steps")


def chain(df: DataFrame, step: Step, schema: str | StructType) -> DataFrame:
    """``df`` after one more step; steps in a row share a task."""
    source, steps = getattr(df, "arrow_steps", (df, ()))
    steps = (*steps, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in steps:
            batches = one(batches)
        return batches

    out = source.mapInArrow(run, schema)
    out.arrow_steps = (source, steps)
    return out


def each(one: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Step:
    """The step that takes batches one by one; empty ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = one(batch)
                if out.num_rows:
                    yield out

    return run


# -- flat columns -----------------------------------------------------------------


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets from 0, values) of an array of lists; null is empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return offsets_of(sizes), lists.flatten()


def offsets_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def owners(offsets: np.ndarray) -> np.ndarray:
    """Number of the list that each value is in."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def listed(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def struct(columns: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def fields(values: pa.StructArray) -> dict[str, pa.Array]:
    return {f.name: values.field(i) for i, f in enumerate(values.type)}


def sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def numbers(column: pa.Array, null: int = 0) -> np.ndarray:
    return pc.fill_null(column, null).to_numpy(zero_copy_only=False).astype(np.int64)


def truths(column: pa.Array) -> np.ndarray:
    """True where it is true; null is not."""
    return pc.fill_null(column, False).to_numpy(zero_copy_only=False)


def coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(codes, distinct values); null has a value of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    found = column.dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy(), found.dictionary


def among(values: pa.Array, words) -> np.ndarray:
    """Whether values are in a list of strings; null is not."""
    return pc.is_in(values, value_set=pa.array(list(words), pa.string()), skip_nulls=True).to_numpy(zero_copy_only=False)


def lowered(values: pa.Array) -> pa.Array:
    """Distinct strings in lower case."""
    wide = pc.invert(pc.fill_null(pc.string_is_ascii(values), True))
    others = pa.array([v.lower() for v in values.filter(wide).to_pylist()], pa.string())
    return pc.replace_with_mask(pc.ascii_lower(values), wide, others)


def joint(codes: list[np.ndarray]) -> np.ndarray:
    """One number for each combination of codes."""
    out = codes[0].astype(np.int64)
    for c in codes[1:]:
        out = out * (int(c.max(initial=0)) + 1) + c
        if out.max(initial=0) > 1 << 40:
            out = pa.array(out).dictionary_encode().indices.to_numpy().astype(np.int64)
    return out


def struct_codes(values: pa.StructArray) -> np.ndarray:
    """One number for each distinct struct of plain fields."""
    return joint([coded(c)[0] for c in fields(values).values()])


def sorted_tokens(offsets: np.ndarray, columns: dict[str, pa.Array]) -> np.ndarray | None:
    """Order of the tokens by unit and the columns, nulls first; None where the ids of every unit ascend already."""
    ids = columns["id"]
    if not len(ids):
        return None
    if not ids.null_count:
        up = np.diff(numbers(ids)) > 0
        edges = offsets[1:-1]
        up[edges[(edges > 0) & (edges < len(ids))] - 1] = True
        if up.all():
            return None
    plain = [ranks(c) if pa.types.is_list(c.type) else c for c in columns.values()]
    table = pa.table({"_unit": owners(offsets), **{f"_{i}": c for i, c in enumerate(plain)}})
    return pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names], null_placement="at_start").to_numpy()


def ranks(lists: pa.Array) -> pa.Array:
    """Rank of lists of structs in the order of arrays, nulls first."""
    key = lambda x: x if x is None else tuple(tuple((v is not None, 0 if v is None else v) for v in f.values()) for f in x)
    values = [key(x) for x in lists.to_pylist()]
    rank = {v: i for i, v in enumerate(sorted({v for v in values if v is not None}))}
    return pa.array([rank.get(v) for v in values], pa.int64())


def pointed(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the token at a place (from 1) of the same unit, for each token; -1 outside of it."""
    first = np.repeat(offsets[:-1], np.diff(offsets)).astype(np.int64)
    size = np.repeat(np.diff(offsets), np.diff(offsets))
    return np.where((at > 0) & (at <= size), first + at - 1, -1)


def followed(offsets: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places that pointers lead to when they are followed until they no longer move (or 2^rounds steps, on a cycle); 0 is null."""
    count = np.diff(offsets)
    rounds = np.repeat(np.ceil(np.log2(count + 1)).astype(int), count)
    out = start
    for k in range(1, int(rounds.max(initial=0)) + 1):
        to = pointed(offsets, out)
        out = np.where(rounds >= k, np.where(to >= 0, out[to], 0), out)
    return out


def places(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32), pa.int32(), mask=values == 0)


# -- what is looked up ----------------------------------------------------------------


def token_kinds(tokens: pa.StructArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(code of each token, form, lemma and pos of each code): tokens are of a kind by form, lemma and whether they are proper."""
    codes, values = zip(*[coded(tokens.field(c)) for c in ("form", "lemma", "pos")])
    proper = numbers(proper_tags(values[2]).cast(pa.int8()), 2)[codes[2]]
    both = pa.array(joint([*codes[:2], proper])).dictionary_encode()
    of = both.indices.to_numpy()
    first = np.empty(len(both.dictionary), np.int64)
    first[of[::-1]] = np.arange(len(of))[::-1]
    return of, {c: v.take(pa.array(k[first])) for c, k, v in zip(("form", "lemma", "pos"), codes, values)}


def proper_tags(pos: pa.Array) -> pa.Array:
    """``matching.all_proper``."""
    return pc.match_substring_regex(pos, r"\A\^( \^)*\z")


def keys(kind: dict[str, pa.Array]) -> pa.Array:
    """The key of ``matching`` for distinct form, lemma and pos; null where nothing can match."""
    text, lemma = lowered(kind["form"]), kind["lemma"]
    second = pc.if_else(
        pc.fill_null(pc.equal(lemma, text), False), pa.scalar("="), pc.fill_null(pc.binary_join_element_wise(pa.scalar("+"), lemma, ""), "-")
    )
    proper = pc.if_else(proper_tags(kind["pos"]), pa.scalar("1"), pa.scalar("0"))
    return pc.binary_join_element_wise(pc.utf8_length(text).cast(pa.string()), pa.scalar(":"), text, second, proper, "")


def told_apart(nodes: Nodes, key: bool) -> Step:
    """A token (form, lemma, pos) of each kind of some millions of tokens; with ``key`` (block, key) of each block."""

    def one(blocks: np.ndarray, copies: pa.Array) -> Iterator[pa.RecordBatch]:
        offsets, of, kind = nodes.kinds(copies)
        if not len(of):
            return
        if not key:
            yield pa.RecordBatch.from_arrays(list(kind.values()), list(kind))
            return
        at = np.repeat(blocks, np.diff(offsets)).astype(np.int64)
        both = np.unique(at * len(kind["form"]) + of)
        block, which = both // len(kind["form"]), both % len(kind["form"])
        yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), keys(kind).take(pa.array(which))], ["block", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        names = ["block", "copy"] if key else ["copy"]

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            get = lambda c: table[c].combine_chunks()
            yield from one(get("block").to_numpy() if key else np.zeros(0), get("copy"))

        for batch in batches:
            if batch.num_rows:
                held.append(batch.select(names))
                n += batch.num_rows
                if n * 24 > GATHERED:
                    yield from out()
                    held, n = [], 0
        if held:
            yield from out()

    return run


def whole(batches: Iterator[pa.RecordBatch], names: list[str], lookup: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, tuple | None]]:
    """Rows of whole units with where each unit begins, and the columns ``lookup`` of what came before them.

    Rows are sorted: first those with a ``key``, then units by id.  The rows of
    the last unit may go on in the next batch.
    """
    block, parts, forms, held = None, [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        n = 0
        if lookup:
            ids = pc.unique(batch["block"]).to_pylist()
            if ids != [block if block is not None else ids[0]]:
                raise RuntimeError("rows of a block were parted")
            block = ids[0]
            n = batch.num_rows - batch["key"].null_count
            if n:
                parts.append(batch.select(lookup).slice(0, n))
        units = pa.Table.from_batches([batch.select(names).slice(n)])
        if units.num_rows:
            if lookup and forms is None:
                known = pa.Table.from_batches(parts or [batch.select(lookup).slice(0, 0)])
                forms = tuple(known[c].combine_chunks() for c in lookup)
            units = units if held is None else pa.concat_tables([held, units])
            *_, last = starts = unit_starts(units[UNIT])
            held = units.slice(last)
            if last:
                yield units.slice(0, last), starts[:-1], forms
    if held is not None:
        yield held, np.zeros(1, np.int64), forms


def unit_starts(ids: pa.ChunkedArray) -> np.ndarray:
    """Where the rows of each unit begin."""
    codes = coded(ids)[0]
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))


def _gathered(units: pa.Table, starts: np.ndarray, nodes: Nodes) -> tuple[pa.Array, np.ndarray, pa.StructArray]:
    """(ids, offsets, tokens) of units, the copies of a unit together and sorted."""
    each_copy, tokens = flat(nodes.arrow(units["copy"].combine_chunks()))
    offsets = each_copy[np.append(starts, units.num_rows)]
    order = sorted_tokens(offsets, fields(tokens))
    if order is not None:
        tokens = tokens.take(pa.array(order))
    return units[UNIT].combine_chunks().take(pa.array(starts)), offsets, tokens


def gathered_step(nodes: Nodes) -> Step:
    """(unit, nodes) from rows sorted by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for units, starts, _ in whole(batches, [UNIT, "copy"], []):
            ids, offsets, tokens = _gathered(units, starts, nodes)
            yield pa.RecordBatch.from_arrays([ids, listed(offsets, tokens)], [UNIT, "nodes"])

    return run


def matched_step(nodes: Nodes, names: list[str]) -> Step:
    """(unit, nodes) with the forms of a block's words in ``struct<n, forms...>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for units, starts, (key, forms) in whole(batches, [UNIT, "copy"], ["key", "forms"]):
            ids, offsets, tokens = _gathered(units, starts, nodes)
            columns = {"n": tokens}
            of, kind = token_kinds(tokens) if len(tokens) else (np.zeros(0, np.int64), None)
            at = numbers(pc.index_in(keys(kind), value_set=key, skip_nulls=True), len(key))[of] if kind else of
            for name in names:
                table = forms.field(name) if len(forms) else pa.array([], forms.type.field(name).type)
                columns[name] = pa.concat_arrays([table, pa.array([[]], table.type)]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids, listed(offsets, struct(columns))], [UNIT, "nodes"])

    return run


# -- phrases --------------------------------------------------------------------------


def neighbours(offsets: np.ndarray, forms: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(place of the first, code, distinct first words, distinct second words) of the pairs of neighbours; words of null make none."""
    codes, texts = coded(forms)
    at = np.arange(max(len(codes) - 1, 0))
    inside = np.ones(len(at), bool)
    inside[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(codes))] - 1] = False
    at = at[inside]
    both = pa.array(codes[at].astype(np.int64) * len(texts) + codes[at + 1]).dictionary_encode()
    pairs = both.dictionary.to_numpy()
    word = lambda k: texts.take(pa.array(k))
    return at, both.indices.to_numpy(), word(pairs // max(len(texts), 1)), word(pairs % max(len(texts), 1))


def pairs_step() -> Step:
    """(unit, one, two) from units: neighbouring words."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, nodes = flat(batch["nodes"])
        at, of, first, second = neighbours(offsets, nodes.field("form"))
        ids = batch[UNIT].take(pa.array(owners(offsets)[at]))
        return pa.RecordBatch.from_arrays([ids, first.take(pa.array(of)), second.take(pa.array(of))], [UNIT, "one", "two"])

    return each(one)


def some_millions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of units put together, up to some millions of tokens."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += len(batch["nodes"].flatten())
            if n > GATHERED:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pair_counts_step() -> Step:
    """(one, two, n): how often words are neighbours in some millions of tokens."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, nodes = flat(batch["nodes"])
        _, of, first, second = neighbours(offsets, nodes.field("form"))
        return pa.RecordBatch.from_arrays([first, second, pa.array(np.bincount(of, minlength=len(first)).astype(np.int64))], ["one", "two", "n"])

    counted = each(one)
    return lambda batches: counted(some_millions(batches))


def pair_key(one: pa.Array, two: pa.Array) -> pa.Array:
    """``phrases.pair`` of distinct words with space between them."""
    return pc.binary_join_element_wise(lowered(one), lowered(two), " ")


def asked_pairs_step(nodes: Nodes) -> Step:
    """(block, key) from rows sorted by unit: the pairs of the units of a block, of some millions of tokens once; units without an id ask for none."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for units, starts, _ in whole(batches, [UNIT, "block", "copy"], []):
            ids, offsets, tokens = _gathered(units, starts, nodes)
            block = units["block"].combine_chunks().take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([ids, block, listed(offsets, tokens)], [UNIT, "block", "nodes"])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, tokens = flat(batch["nodes"])
        at, of, first, second = neighbours(offsets, tokens.field("form"))
        unit = owners(offsets)[at]
        known = ~batch[UNIT].is_null().to_numpy(zero_copy_only=False)[unit]
        both = np.unique(numbers(batch["block"])[unit[known]] * len(first) + of[known])
        which = both % max(len(first), 1)
        return pa.RecordBatch.from_arrays([pa.array((both // max(len(first), 1)).astype(np.int32)), pair_key(first, second).take(pa.array(which))], ["block", "key"])

    step = each(one)
    return lambda batches: step(some_millions(gathered(batches)))


def leftmost(unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which spans count: longest at a start, then leftmost first (``phrases.leftmost``); in order of unit and start."""
    left = np.lexsort((-size, start, unit))
    left = left[start[left] >= -1]
    taken = []
    while len(left):
        first = left[np.concatenate([[True], unit[left][1:] != unit[left][:-1]])]
        taken.append(first)
        free = start[first] + size[first]
        left = left[start[left] >= free[np.searchsorted(unit[first], unit[left])]]
    taken = np.concatenate(taken) if taken else left
    return taken[np.lexsort((start[taken], unit[taken]))]


def merged_step(nodes: Nodes) -> Step:
    """(unit, nodes) after phrases were merged; ``hits`` has the entries of a pair as ``struct<at, len, term>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for units, starts, (key, hits) in whole(batches, [UNIT, "copy"], ["key", "hits"]):
            ids, offsets, tokens = _gathered(units, starts, nodes)
            yield _merged(ids, offsets, tokens, key, hits)

    return run


def _merged(unit_ids: pa.Array, offsets: np.ndarray, tokens: pa.StructArray, key: pa.Array, hits: pa.ListArray) -> pa.RecordBatch:
    n, owner = fields(tokens), owners(offsets)
    ids, heads = numbers(n["id"]), n["head"]
    linked = ~unit_ids.is_null().to_numpy(zero_copy_only=False)[owner]
    # Places of entries: those all of whose pairs stand there.
    at, of, first, second = neighbours(offsets, n["form"])
    found = numbers(pc.index_in(pair_key(first, second), value_set=key, skip_nulls=True), -1)[of] if len(at) else np.zeros(0, np.int64)
    real = (found >= 0) & linked[at]
    lists, entry = flat(hits.take(pa.array(found[real])))
    place = at[real][owners(lists)]
    unit, start, size = owner[place], ids[place] - numbers(entry.field("at")), numbers(entry.field("len"))
    both = joint([unit, start - start.min(initial=0), size, coded(entry.field("term"))[0]])
    _, one, count = np.unique(both, return_index=True, return_counts=True)
    one = one[count == size[one] - 1]
    one = one[leftmost(unit[one], start[one], size[one])]
    # The span of each token, by its id.
    spans, mine = (unit[one] << 32) + start[one], (owner << 32) + ids
    span = np.searchsorted(spans, mine, "right") - 1
    group = ids.copy()
    if len(one):
        within = (span >= 0) & (unit[one][span] == owner) & (ids < (start + size)[one][span])
        group = np.where(within, start[one][span], ids)
    # Tokens meet the tokens of their head's id; each of several makes the token come again.
    order = np.argsort(mine, kind="stable")
    asked = (owner << 32) + numbers(heads)
    low, high = np.searchsorted(mine[order], asked, "left"), np.searchsorted(mine[order], asked, "right")
    over = np.where(linked & ~heads.is_null().to_numpy(zero_copy_only=False), high - low, 0)
    to = numbers(heads)
    to = np.where(to > 0, np.where(over > 0, group[order[np.minimum(low, len(order) - 1)]], -1) if len(order) else to, to)
    times = np.maximum(over, 1)
    every = np.repeat(np.arange(len(ids)), times)
    parts = {c: n[c] for c in ("id", "form", "lemma", "pos")}
    table = {"u": owner, "g": group, **parts, "hg": pa.array(to, mask=heads.is_null().to_numpy(zero_copy_only=False))}
    if (times > 1).any() or (np.diff((owner << 32) + group) < 0).any() or (np.diff(mine) <= 0).any():
        rows = pa.table(table).append_column("i", pa.array(np.arange(len(ids)))).take(pa.array(every))
        every = every[pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in rows.column_names], null_placement="at_start").to_numpy()]
    own, g = owner[every], group[every]
    name = (own << 32) + g
    begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(every) else np.zeros(0, np.int64)
    cuts = np.append(begin, len(every))
    joined = lambda c: pc.binary_join(listed(cuts, n[c].take(pa.array(every))), " ")
    # The head of the first part that points out of the group.
    missing = heads.is_null().to_numpy(zero_copy_only=False)[every]
    out = np.flatnonzero((to[every] != g) & ~missing)
    part = np.searchsorted(out, begin)
    has = (part < len(out)) & (out[np.minimum(part, max(len(out) - 1, 0))] < cuts[1:]) if len(out) else np.zeros(len(begin), bool)
    h = np.where(has, to[every][out[np.minimum(part, max(len(out) - 1, 0))]], 0) if len(out) else np.zeros(len(begin), np.int64)
    first_of = np.searchsorted(own[begin], np.arange(len(unit_ids)))
    number = np.arange(len(begin)) - first_of[own[begin]] + 1
    aim = (own[begin] << 32) + h
    to_group = np.searchsorted(name[begin], aim)
    inside = (to_group < len(begin)) & (name[begin][np.minimum(to_group, max(len(begin) - 1, 0))] == aim) if len(begin) else np.zeros(0, bool)
    head = np.where(h > 0, number[np.minimum(to_group, max(len(begin) - 1, 0))], h) if len(begin) else h
    columns = {"id": pa.array(number.astype(np.int32))} | {c: joined(c) for c in ("form", "lemma", "pos")}
    columns |= {"head": pa.array(head.astype(np.int32), mask=(h > 0) & ~inside), "n_parts": pa.array(np.diff(cuts).astype(np.int32))}
    columns |= {c: v.take(pa.array(every[begin])) for c, v in n.items() if c not in ("id", "form", "lemma", "pos", "head")}
    ends = np.append(first_of, len(begin))
    return pa.RecordBatch.from_arrays([unit_ids, listed(ends, struct(columns))], [UNIT, "nodes"])


# -- flags ----------------------------------------------------------------------------


def flagged_step(rules, words, no_plural, mention_tags) -> Step:
    """``struct<n, id_forms, sent_forms>`` as plain tokens that also tell ``negated``, ``is_address`` and ``mention``."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, every = flat(batch["nodes"])
        n, ids = fields(every.field("n")), every.field("id_forms")
        of, forms = coded(n["form"])
        text = lowered(forms)
        plural = truths(pc.ends_with(text, "s")) & ~among(text, no_plural)
        negated = among(text, words) | (plural & among(pc.utf8_slice_codeunits(text, 0, -1), words))
        place = np.arange(len(of))
        first, last = np.zeros(len(of), bool), np.zeros(len(of), bool)
        filled = np.diff(offsets) > 0
        first[offsets[:-1][filled]], last[offsets[1:][filled] - 1] = True, True
        address = np.zeros(len(of), bool)
        for own, before, after in rules:
            beside = among(text, before)[of[place - 1]] & ~first if before else False
            if after:
                beside = beside | (among(text, after)[of[(place + 1) % max(len(of), 1)]] & ~last)
            address |= among(text, own)[of] & beside
        if "n_parts" in n:
            address &= numbers(n["n_parts"]) == 1
        mention = (sizes(ids) > 0) & mention_tags(n["pos"], n["ptb"]) & ~address
        flags = {"negated": negated[of], "is_address": address, "mention": mention}
        columns = n | {"id_forms": ids, "sent_forms": every.field("sent_forms")} | {k: pa.array(v, pa.bool_()) for k, v in flags.items()}
        return pa.RecordBatch.from_arrays([batch[UNIT], listed(offsets, struct(columns))], [UNIT, "nodes"])

    return each(one)


def counts_step(flags: list[str]) -> Step:
    """(unit, tokens, flags): numbers of tokens."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, nodes = flat(batch["nodes"])
        count = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]).astype(np.int32))
        return pa.RecordBatch.from_arrays([batch[UNIT], count(np.ones(len(nodes), int)), *[count(truths(nodes.field(c))) for c in flags]], [UNIT, "tokens", *flags])

    return each(one)


def tokens_step(names: list[str]) -> Step:
    """One row for each token, with the named fields."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, nodes = flat(batch["nodes"])
        ids = batch[UNIT].take(pa.array(owners(offsets)))
        return pa.RecordBatch.from_arrays([ids, *[nodes.field(c) for c in names]], [UNIT, *names])

    return each(one)


# -- frames -----------------------------------------------------------------------------


def frames_step(form: pa.DataType) -> Step:
    """Frames of units with a mention: user, nodes of ``constraints.frames_of``, roots and stand-ins."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, nodes = flat(batch["nodes"])
        owner, mention = owners(offsets), truths(nodes.field("mention"))
        keep = np.zeros(batch.num_rows, bool)
        keep[owner[mention]] = True
        ids = batch[UNIT].filter(pa.array(keep))
        nodes = nodes.filter(pa.array(keep[owner]))
        offsets = offsets_of(np.diff(offsets)[keep])
        users = nodes.field("user_id").take(pa.array(offsets[:-1]))
        of, text = coded(nodes.field("form"))
        shaped = {"id": nodes.field("id"), "head": nodes.field("head"), "form": lowered(text).take(pa.array(of))}
        shaped |= {c: nodes.field(c) for c in ("lemma", "pos", "ptb", "label")}
        plain = shaped | {"mention": nodes.field("mention"), "neg": nodes.field("negated")}
        shaped |= {"idf": renamed(nodes.field("id_forms"), form), "snf": renamed(nodes.field("sent_forms"), form)}
        shaped |= {"mention": plain["mention"], "neg": plain["neg"]}
        order = sorted_tokens(offsets, plain)
        shaped = struct(shaped) if order is None else struct(shaped).take(pa.array(order))
        found = [roots(offsets, shaped), resolved(offsets, shaped)]
        arrays = [ids, users, listed(offsets, shaped), *[listed(offsets, places(x)) for x in found]]
        return pa.RecordBatch.from_arrays(arrays, [UNIT, "user_id", "nodes", "roots", "res"])

    return each(one)


def renamed(lists: pa.ListArray, form: pa.DataType) -> pa.ListArray:
    """Lists of structs with the names and types of ``form``, field by field."""
    offsets, values = flat(lists)
    columns = [c.cast(f.type) for c, f in zip(fields(values).values(), form, strict=True)]
    return listed(offsets, pa.StructArray.from_arrays(columns, fields=list(form)))


def roots(offsets: np.ndarray, nodes: pa.StructArray) -> np.ndarray:
    """``tree.root_array``; 0 for null."""
    ids, heads = numbers(nodes.field("id")), numbers(nodes.field("head"), 1)
    known = ~nodes.field("head").is_null().to_numpy(zero_copy_only=False)
    end = followed(offsets, np.where(known & (heads > 0), heads, ids))
    to = pointed(offsets, end)
    return np.where((to >= 0) & known[to] & (heads[to] <= 0), end, 0)


def resolved(offsets: np.ndarray, nodes: pa.StructArray) -> np.ndarray:
    """``tree.resolved_array``; 0 for null."""
    ids = numbers(nodes.field("id"))
    of, tags = coded(nodes.field("pos"))
    first = first_children(offsets, numbers(nodes.field("head")), ids)
    return followed(offsets, np.where(among(tags, ["D"])[of] & (first > 0), first, ids))


def first_children(offsets: np.ndarray, heads: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place (from 1) of the first token of the unit whose head a token is; 0 without one."""
    kids, where = np.unique(in_unit(offsets, heads), return_index=True)
    at = np.searchsorted(kids, in_unit(offsets, ids))
    hit = (at < len(kids)) & (kids[np.minimum(at, len(kids) - 1)] == in_unit(offsets, ids)) if len(kids) else np.zeros(len(ids), bool)
    first = where[np.minimum(at, max(len(kids) - 1, 0))] if len(kids) else at
    return np.where(hit, first - np.repeat(offsets[:-1], np.diff(offsets)) + 1, 0)


def in_unit(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One number for a unit and a token id of it."""
    return owners(offsets).astype(np.int64) << 32 | (values.astype(np.int64) + (1 << 31))


# -- trees --------------------------------------------------------------------------------


def roots_of_mentions(offsets: np.ndarray, nodes: pa.StructArray) -> np.ndarray:
    """Which tokens are mentions whose head is no mention, by ids."""
    mention = truths(nodes.field("mention"))
    ids = in_unit(offsets, numbers(nodes.field("id")))[mention]
    heads = nodes.field("head")
    under = np.isin(in_unit(offsets, numbers(heads))[mention], ids) & ~heads.is_null().to_numpy(zero_copy_only=False)[mention]
    mention[np.flatnonzero(mention)[under]] = False
    return mention


def descendants_step() -> Step:
    """(unit, ancestor, id) of every known token below another."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, nodes = flat(batch["nodes"])
        ids, heads = nodes.field("id"), numbers(nodes.field("head"))
        size = np.repeat(np.diff(offsets), np.diff(offsets))
        at = np.flatnonzero(truths(nodes.field("known")))
        first, owner = np.repeat(offsets[:-1], np.diff(offsets)), owners(offsets)
        cur, seen, rows, step = heads[at], [], [], 0
        while True:
            go = (cur > 0) & (step < size[at])
            for past in seen:
                go &= past != cur
            at, cur, seen = at[go], cur[go], [past[go] for past in seen]
            if not len(at):
                break
            rows.append((at, cur))
            seen.append(cur)
            inside = cur <= size[at]
            cur = np.where(inside, heads[np.where(inside, first[at] + cur - 1, 0)], 0)
            step += 1
        at, up = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        arrays = [batch[UNIT].take(pa.array(owner[at])), pa.array(up.astype(np.int32)), ids.take(pa.array(at))]
        return pa.RecordBatch.from_arrays(arrays, [UNIT, "ancestor", "id"])

    return each(one)


def plain_step(names: list[str], known: str | None) -> Step:
    """Nodes of the named fields, sorted by them."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, nodes = flat(batch["nodes"])
        columns = {c: nodes.field(c) for c in names}
        if known:
            columns["known"] = pa.array(sizes(nodes.field(known)) > 0)
        order = sorted_tokens(offsets, columns)
        out = struct(columns) if order is None else struct(columns).take(pa.array(order))
        return pa.RecordBatch.from_arrays([batch[UNIT], listed(offsets, out)], [UNIT, "nodes"])

    return each(one)


def selected_step(which: Callable[[np.ndarray, pa.StructArray], np.ndarray], names: list[str]) -> Step:
    """One row for each token that is chosen, with the named fields."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, nodes = flat(batch["nodes"])
        at = pa.array(np.flatnonzero(which(offsets, nodes)))
        return pa.RecordBatch.from_arrays([batch[UNIT].take(pa.array(owners(offsets)).take(at)), *[nodes.field(c).take(at) for c in names]], [UNIT, *names])

    return each(one)


def modifiers_step(remove: list[str], fits: Callable[[pa.Array], np.ndarray]) -> Step:
    """(unit, id, id_mods, word_mods) of tokens that have modifiers: noun and adjective children."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, nodes = flat(batch["nodes"])
        of, tags = coded(nodes.field("pos"))
        kids = np.flatnonzero(fits(tags)[of] & ~nodes.field("head").is_null().to_numpy(zero_copy_only=False))
        ids = in_unit(offsets, numbers(nodes.field("id")))
        # Parents of equal id have the same children; each is a row.
        names, name_of = np.unique(ids, return_inverse=True)
        heads = in_unit(offsets, numbers(nodes.field("head")))[kids]
        at = np.searchsorted(names, heads)
        real = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == heads)
        kids, at = kids[real], at[real]

        def kept(name: str, of_kids: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
            """(kid number, parent, form) of the forms that are left."""
            lists, forms = flat(nodes.field(name).take(pa.array(kids[of_kids])))
            code, terms = coded(forms.field("term"))
            fit = np.flatnonzero((~among(terms, remove) & ~terms.is_null().to_numpy(zero_copy_only=False))[code])
            kid = of_kids[owners(lists)[fit]]
            return kid, at[kid], forms.take(pa.array(fit))

        kid, parent, forms = kept("id_forms", np.arange(len(kids)))
        without = np.ones(len(kids), bool)
        without[kid] = False
        # Identities are a set, by term; words are a list, in the order of the children.
        once = np.sort(np.unique(joint([parent, struct_codes(forms)]), return_index=True)[1]) if len(forms) else np.zeros(0, np.int64)
        parent, terms = parent[once], forms.field("term").take(pa.array(once))
        order = pc.sort_indices(pa.table({"p": parent, "t": terms}), sort_keys=[("p", "ascending"), ("t", "ascending")])
        id_lists = listed(offsets_of(np.bincount(parent, minlength=len(names))), terms.take(order))
        kid, parent, forms = kept("sent_forms", np.flatnonzero(without))
        order = np.argsort(parent, kind="stable")
        word_lists = listed(offsets_of(np.bincount(parent, minlength=len(names))), forms.field("term").take(pa.array(order)))
        any_ = (sizes(id_lists) > 0) | (sizes(word_lists) > 0)
        rows = np.flatnonzero(any_[name_of])
        of_row = pa.array(name_of[rows])
        arrays = [batch[UNIT].take(pa.array(owners(offsets)[rows])), nodes.field("id").take(pa.array(rows)), id_lists.take(of_row), word_lists.take(of_row)]
        return pa.RecordBatch.from_arrays(arrays, [UNIT, "id", "id_mods", "word_mods"])

    return each(one)


# -- clauses ------------------------------------------------------------------------------


def clause_values(offsets: np.ndarray, nodes: pa.StructArray, root_of: np.ndarray, words: np.ndarray, negation: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sorted clauses, strongest e, p and a of each): of equal strength the first; ``words`` tells which tokens count."""
    words = np.flatnonzero(words & (root_of > 0))
    lists, forms = flat(nodes.field("snf").take(pa.array(words)))
    word = words[owners(lists)]
    clause = in_unit(offsets, root_of)[word]
    sign = np.where(truths(nodes.field("neg"))[word], -1.0, 1.0) if negation else 1.0
    found, out = np.unique(clause), []
    for d in "epa":
        x = sign * pc.fill_null(forms.field(d), 0.0).to_numpy(zero_copy_only=False)
        order = np.lexsort((-np.abs(x), clause))
        first = order[np.searchsorted(clause[order], found)]
        out.append(np.where(x[first] == 0, 0.0, x[first]))
    return found, out


def _clauses_of_mentions(batch: pa.RecordBatch, words_fit: Callable[[pa.Array], np.ndarray], negation: bool):
    """Root mentions of frames whose clause has values, and these."""
    offsets, nodes = flat(batch["nodes"])
    ids, mention = numbers(nodes.field("id")), truths(nodes.field("mention"))
    roots_ = numbers(batch["roots"].flatten())
    at = pointed(offsets, ids)
    root_of = np.where(at >= 0, roots_[at], 0) if len(at) else at
    of, tags = coded(nodes.field("pos"))
    words = words_fit(tags)[of] & (sizes(nodes.field("idf")) == 0) & (sizes(nodes.field("snf")) > 0)
    clauses, values = clause_values(offsets, nodes, root_of, words, negation)
    above = pointed(offsets, numbers(nodes.field("head")))
    rm = np.flatnonzero(mention & ~((above >= 0) & mention[above])) if len(ids) else ids
    mine = in_unit(offsets, root_of)[rm]
    clause = np.searchsorted(clauses, mine)
    real = (clause < len(clauses)) & (root_of[rm] > 0)
    real[real] = clauses[clause[real]] == mine[real]
    rm, clause = rm[real], clause[real]
    return offsets, nodes, rm, [v[clause] for v in values]


def clause_values_step(words_fit: Callable[[pa.Array], np.ndarray], negation: bool) -> Step:
    """(unit, id, e, p, a) of root mentions from frames."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, nodes, rm, values = _clauses_of_mentions(batch, words_fit, negation)
        unit = batch[UNIT].take(pa.array(owners(offsets)[rm]))
        return pa.RecordBatch.from_arrays([unit, nodes.field("id").take(pa.array(rm)), *map(pa.array, values)], [UNIT, "id", *"epa"])

    return each(one)


def clause_rows_step(words_fit, kids_fit, negation: bool, phase: int, schema: pa.Schema) -> Step:
    """Rows of ``constraints.clause_constraint`` from frames: a mention and its identity modifiers at the values of its clause."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, nodes, rm, values = _clauses_of_mentions(batch, words_fit, negation)
        owner, ids = owners(offsets), in_unit(offsets, numbers(nodes.field("id")))
        own_lists, own = flat(nodes.field("idf").take(pa.array(rm)))
        # Identity forms of the children, without the mention's own terms, each once.
        of, tags = coded(nodes.field("pos"))
        kids = np.flatnonzero(kids_fit(tags)[of] & (sizes(nodes.field("idf")) > 0) & ~nodes.field("head").is_null().to_numpy(zero_copy_only=False))
        heads = in_unit(offsets, numbers(nodes.field("head")))[kids]
        order = np.argsort(heads, kind="stable")
        low, high = (np.searchsorted(heads[order], ids[rm], s) for s in ("left", "right"))
        count = high - low
        parent = np.repeat(np.arange(len(rm)), count)
        kid = kids[order][np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
        lists, forms = flat(nodes.field("idf").take(pa.array(kid)))
        parent = parent[owners(lists)]
        mine = owners(own_lists)
        codes = coded(pa.concat_arrays([own.field("term"), forms.field("term")]))[0].astype(np.int64)
        left = np.flatnonzero(~np.isin(parent << 32 | codes[len(mine) :], mine << 32 | codes[: len(mine)]) & ~forms.field("term").is_null().to_numpy(zero_copy_only=False))
        parent, forms = parent[left], forms.take(pa.array(left))
        once = np.sort(np.unique(joint([parent, struct_codes(forms)]), return_index=True)[1]) if len(forms) else left
        parent, forms = parent[once], forms.take(pa.array(once))
        # The head word, its modifiers, the earlier words of the mention.
        last = np.zeros(len(mine), bool)
        last[own_lists[1:] - 1] = True
        every = pa.concat_arrays([own, forms])
        who = np.concatenate([mine, parent])
        turn = np.concatenate([np.where(last, 0, 2), np.ones(len(parent), int)])
        order = np.lexsort((np.arange(len(who)), turn, who))
        who, every = who[order], every.take(pa.array(order))
        begin = np.searchsorted(who, np.arange(len(rm)))
        sub = np.arange(len(who)) - begin[who]
        at, n = pa.array(rm[who]), len(who)
        idx = every.field("idx")
        known = idx.is_null()
        operand = {"role": pa.array(["a"] * n, pa.string()), "entity": every.field("id"), "idx": idx}
        operand |= {d: pc.if_else(known, every.field(d), None) for d in "epa"}
        same = lambda v, t: pa.repeat(pa.scalar(v, t), n)
        ones = np.arange(n + 1)
        has = ~known.to_numpy(zero_copy_only=False)
        columns = [
            batch[UNIT].take(pa.array(owner[rm[who]])), batch["user_id"].take(pa.array(owner[rm[who]])), nodes.field("id").take(at), same(phase, pa.int32()), same(0, pa.int32()),
            same(0, pa.int32()), pa.array(sub.astype(np.int32)), same("clause", pa.string()), same("point", pa.string()), same(False, pa.bool_()),
            listed(ones, struct(operand)), listed(offsets_of(has.astype(int)), idx.drop_null()), *[pa.array(v[who]) for v in values],
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema.names)

    return each(one)
