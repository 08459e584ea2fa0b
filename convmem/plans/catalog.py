"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of queries; each has Q and SQL.
MODULES = ("conversation", "ledgers", "texts", "people", "extras", "composites", "ingest", "streams", "recaps", "throughlines", "exported", "imports")


def _all(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"convmem.plans.{m}"), name).items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("Q")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
