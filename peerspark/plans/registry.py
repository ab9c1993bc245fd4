"""Named queries and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import PRELUDE

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``sql`` may start with WITH and use the prelude's tables."""
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            prelude = PRELUDE.replace("WITH", "WITH RECURSIVE", 1) if "reach(" in body else PRELUDE
            ORACLES[name] = prelude + (", " + body[5:] if body.upper().startswith("WITH ") else "\n" + body)
        return fn
    return register
