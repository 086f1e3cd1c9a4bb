"""Registered queries: each runs over the given tables, with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = ("tables", "texts", "tokens", "sequences", "choosing", "batches", "statistics", "scoring", "overlap")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for module in MODULES:
        import_module(f"sheafwork.plans.queries.{module}")
