"""Odds entries of nested JSON bodies, at whatever depth they stand."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

ENTRY = "id bigint, bookmaker string, path string, outcome string, price double, active boolean"
NAMES = ("outcomeName", "participantName", "name", "label")
ACTIVE = ("active", "isActive", "is_active")


def _first(node: dict, names: tuple[str, ...], kind: type) -> object:
    return next((node[n] for n in names if isinstance(node.get(n), kind)), None)


def _entries(node: object, path: str) -> Iterator[tuple]:
    """Every object with a price below ``node``, named by itself or its nearest named ancestor; depth first with a stack of its own."""
    stack = [(node, path, None)]
    while stack:
        at, where, name = stack.pop()
        if isinstance(at, list):
            inner = enumerate(at)
        elif isinstance(at, dict):
            name = _first(at, NAMES, str) or name
            if "price" in at:
                price = at["price"]
                number = isinstance(price, int | float) and not isinstance(price, bool)
                yield where, name, float(price) if number else None, _first(at, ACTIVE, bool)
            inner = at.items()
        else:
            continue
        stack.extend((value, f"{where}.{key}", name) for key, value in inner)


def _books(body: object) -> Iterator[tuple[str, str, object]]:
    node = body.get("bookmakers") if isinstance(body, dict) else None
    if isinstance(node, list):
        for i, book in enumerate(node):
            if isinstance(book, dict):
                yield _first(book, ("slug", "key", "name"), str) or f"book-{i}", f"bookmakers.{i}", book
    elif isinstance(node, dict):
        for slug, book in node.items():
            yield slug, f"bookmakers.{slug}", book


def odds_entries(bodies: DataFrame) -> DataFrame:
    """``ENTRY`` rows of ``bodies`` (id, body): bookmakers are a list or a map. A body that is no JSON has none.

    Depth and envelope of the bodies vary, which expressions of a fixed depth cannot follow; hence Python by Arrow batch.
    """

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in zip(batch["id"], batch["body"], strict=True):
                try:
                    body = json.loads(text) if text else None
                except (ValueError, RecursionError):
                    continue
                out += [(key, slug, *entry) for slug, path, book in _books(body) for entry in _entries(book, path)]
            yield pd.DataFrame(out, columns=["id", "bookmaker", "path", "outcome", "price", "active"])

    return bodies.select("id", "body").mapInPandas(flatten, ENTRY)
