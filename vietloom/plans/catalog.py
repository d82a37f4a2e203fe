"""Names every query of the core and its SQL."""

from __future__ import annotations

import importlib

_MODULES = ("curation", "sampling", "review", "evaluation", "mixing", "checks")


def _all(name: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{m}"), name, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
