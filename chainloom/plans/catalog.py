"""All named queries of the core and their SQL counterparts."""

from __future__ import annotations

import importlib

from chainloom.operators import orphans, scores

#: Modules of this package that hold a ``part``.
_FAMILIES = ("aggregates", "ranks", "selects", "texts", "statistics", "modelling", "space", "registries", "inputs")


def _parts() -> list:
    return [orphans, scores, *(importlib.import_module(f"chainloom.plans.{m}").part for m in _FAMILIES)]


def queries() -> dict:
    return {k: f for part in _parts() for k, f in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for part in _parts() for k, s in part.ORACLE.items()}
