"""Proof queries: every operator on the given tables, with its SQL twin."""

from .base import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]
