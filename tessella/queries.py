"""Registered queries of the core library, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import analysis, members, nested, relational, scalars, systems

_ALL = {f: sql for module in (relational, scalars, nested, members, analysis, systems) for f, sql in module.QUERIES_SQL.items()}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {f.__name__: sql for f, sql in _ALL.items() if sql}
