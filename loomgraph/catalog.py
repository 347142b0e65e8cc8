"""Queries of the engine's own operators over the test tables, with their DuckDB equivalents."""

from __future__ import annotations

import importlib

from loomgraph.queries import base

for _name in ("predicates", "search", "rollup", "classes", "text", "evidence", "verbs", "coverage"):
    importlib.import_module(f"loomgraph.queries.{_name}")


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.ORACLE)
