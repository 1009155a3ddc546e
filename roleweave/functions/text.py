"""String columns: terms, phrases, plural forms, unit text and masking."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import NO_PLURAL

# ASCII punctuation written without a space before it.
PUNCTUATION = list("!#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def clean_term(term: Column, prefix_only: bool = True) -> Column:
    """Strip ``i_``, ``b_``, ``m_`` once each, then underscores become spaces."""
    out = term
    for prefix in ("i_", "b_", "m_"):
        if prefix_only:
            out = F.regexp_replace(out, f"^{prefix}", "")
        else:
            out = F.regexp_replace(out, f"^(.*?){prefix}", "$1")
    return F.replace(out, F.lit("_"), F.lit(" "))


def has_digit(term: Column) -> Column:
    return term.rlike("[0-9]")


def split_phrase(text: Column) -> Column:
    """Parts of a phrase: splits on blanks, on quotes, on ``-`` and on ``/``."""
    parts = F.concat(
        F.split(text, r"\s+"),
        F.split(text, "['\"`‘“’”]"),
        F.split(text, "-"),
        F.split(text, "/"),
    )
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def strip_plural(text: Column, whole_token: bool = True) -> Column:
    """``text`` without a final s, or null where the plural rule does not apply."""
    if whole_token:
        applies = text.endswith("s") & ~text.isin(NO_PLURAL)
    else:
        applies = text.endswith("s") & (F.length(text) > 3)
    return F.when(applies, F.substring(text, F.lit(1), F.length(text) - 1))


def unit_text(tokens: Column) -> Column:
    """Tokens joined by blanks, none before punctuation other than ``"``."""
    lone = F.array(*[F.lit(p) for p in PUNCTUATION])
    spaced = F.transform(
        tokens, lambda t, i: F.when((i == 0) | F.array_contains(lone, t), t).otherwise(F.concat(F.lit(" "), t))
    )
    return F.array_join(spaced, "")


def mask_identity(tokens: Column, identity: Column) -> Column:
    """Text with the mention hidden: ``identity`` for one-word names (or name+s),
    ``compound identity`` for every occurrence of a multiword name."""
    hidden = F.transform(
        tokens,
        lambda t: F.when(
            (F.lower(t) == identity) | (F.lower(t) == F.concat(identity, F.lit("s"))), F.lit("identity")
        ).otherwise(t),
    )
    joined = F.array_join(hidden, " ")
    return F.when(
        F.contains(identity, F.lit(" ")), F.replace(joined, identity, F.lit("compound identity"))
    ).otherwise(joined)


def symbol_pattern(symbols: list[str]) -> str:
    """One alternation for a bounded symbol list, escaped, longest first."""
    return "|".join(re.escape(s) for s in sorted(symbols, key=lambda s: (-len(s), s)))


def extract_symbols(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def explode_ids(ids: Column) -> Column:
    """One row per id of a comma-joined list."""
    return F.explode(F.split(ids, ","))
