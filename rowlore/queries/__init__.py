"""Every operator as a query over the given tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("values", "filters", "catalog", "retrieval", "documents", "files", "stores", "questions")


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found.update(import_module(f"rowlore.queries.{name}").BOOK.queries)
    return found


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found.update(import_module(f"rowlore.queries.{name}").BOOK.sql)
    return found
