"""All queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import importlib

_MODULES = ("queries_a", "queries_b", "queries_c")


def _all(name: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{m}"), name, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
