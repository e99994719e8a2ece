"""Registered queries: every operator on the provided tables, with SQL to check it."""

from __future__ import annotations

from . import columns, explaining, features, metrics, modelling, profiling, quality, sampling, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
