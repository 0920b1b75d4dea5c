"""Queries over the given tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from loglantern.plans import (
    enrich_queries,
    legacy_queries,
    line_queries,
    model_queries,
    profile_queries,
)

_MODULES = (line_queries, legacy_queries, profile_queries, enrich_queries, model_queries)


def all_queries() -> dict:
    return {name: build for module in _MODULES for name, build in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
