"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q_pages", "q_scalars", "q_history", "q_star", "q_export", "q_model")


def _all(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), name).items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .q_pages import flagship as f

    return f(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
