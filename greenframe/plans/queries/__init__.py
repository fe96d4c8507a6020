"""Ready-made queries over the test tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["workload", "telemetry", "profiling", "repair", "comparison", "synthesis", "live"]


def _loaded():
    return [importlib.import_module(f"{__name__}.{name}") for name in MODULES]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in _loaded() for name, run in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in _loaded() for name, sql in module.ORACLES.items()}
