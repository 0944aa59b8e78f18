"""The operators as queries over the test tables, each with the SQL that checks it."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("rows", "joins", "sweeps", "lists")


def _all(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__name__}.{name}"), kind)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
