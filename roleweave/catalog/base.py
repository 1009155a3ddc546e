"""Registry of proof queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = ["lexicon", "relational", "text", "units", "algebra", "scoring", "network", "chains", "files"]


@dataclass(frozen=True)
class Proof:
    name: str
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Proof] = {}


def proof(name: str, ids: str, sql: str | None = None):
    """Register a query with the blueprint ids it shows and its SQL twin."""

    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Proof(name, ids, fn, sql)
        return fn

    return wrap


def load_all() -> dict[str, Proof]:
    for m in MODULES:
        importlib.import_module(f"roleweave.catalog.{m}")
    return REGISTRY
