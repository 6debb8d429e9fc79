"""Registered queries of the core and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("cleaning", "relations", "edges", "features", "walks", "corpus")


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"{__name__}.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"{__name__}.{m}").ORACLE
    return out
