"""Registry of the engine's named queries and of their independent SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this package that hold registered queries, in build order.
MODULES: tuple[str, ...] = ("scores", "evaluation", "graph", "text", "stats", "measure", "extras", "sources", "guards")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found.update(import_module(f"brindle.plans.{name}").QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found.update(import_module(f"brindle.plans.{name}").ORACLES)
    return found
