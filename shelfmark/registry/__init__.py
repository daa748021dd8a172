"""Registered queries over the given tables, each with its SQL where there is one."""

from __future__ import annotations


def _modules():
    from shelfmark.registry import (
        audit, catalog, duplicates, events, palette, people, search, sources,
    )

    return [search, people, events, duplicates, catalog, palette, audit, sources]


def queries() -> dict:
    return {name: run for module in _modules() for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLE.items()}
