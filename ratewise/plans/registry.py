"""Query registry: name → (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the driver tables (or data Spark derives from them).  Computed columns are
aliased identically in Spark and SQL; double columns are rounded to 6
decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: str
    headline: bool = False


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None, operators: str, headline: bool = False):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, operators, headline)
        return fn
    return deco


def _load_all():
    # Importing the stage modules registers their queries.
    from . import q_analysis, q_clean, q_explain, q_models, q_sample, q_summary, q_twopart  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {k: v.build for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v.sql for k, v in REGISTRY.items() if v.sql is not None}
