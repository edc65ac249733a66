"""All queries and their SQL by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("ingesting", "analysis", "learning")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"varnika.plans.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
