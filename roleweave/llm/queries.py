"""Loads the modules that register this folder's queries."""

from . import (  # noqa: F401
    chat,
    decontaminate,
    licenses,
    line_dedup,
    minhash,
    mixing,
    periodic_runs,
    phrases,
    quality_classifier,
    quality_rules,
    relative_lz,
    simhash,
    suffix_dedup,
)
from .base import ORACLES, QUERIES  # noqa: F401
