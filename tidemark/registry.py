"""All registered queries with their SQL."""

from __future__ import annotations

import importlib

from .plans._base import Query

FAMILIES = ("quotes", "portfolio", "detection", "evaluation", "backtests", "texts", "digests", "graphs", "bins", "entities", "odds", "relations", "lifecycle", "streams", "details", "datasets")


def queries() -> dict[str, Query]:
    return {name: q for family in FAMILIES for name, q in importlib.import_module(f"tidemark.plans.{family}").FAMILY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for family in FAMILIES for name, s in importlib.import_module(f"tidemark.plans.{family}").FAMILY.sql.items()}
