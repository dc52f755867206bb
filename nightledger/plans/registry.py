"""All registered queries of the library."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapter import Model

MODULES = ("layer", "kpis", "dq", "revenue", "analytics", "queue", "others", "risks", "changes", "sketches", "details")


def _all() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for name in MODULES:
        out |= import_module(f"{__package__}.{name}").QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Model(spark, sf_dir))) for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for name, (_, q) in _all().items() if q}
