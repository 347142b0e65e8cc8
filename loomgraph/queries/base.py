"""A registry of queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import projection
from loomgraph.plans.projection import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PRELUDE = {"nodes": projection.P1_NODES, "edges": projection.P1_EDGES, "files": projection.P3_FILES, "steps": projection.P2_EDGES}


def over(*names: str, recursive: bool = False) -> str:
    """The start of an oracle: common table expressions of the projections it reads."""
    return "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(f"{n} AS ({projection.duck(PRELUDE[n])})" for n in names)


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of :class:`Tables` as a query of the driver's form."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return fn

    return register
