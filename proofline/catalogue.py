"""The query catalogue: every registered query with its DuckDB equivalent."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proofline.plans import dataset
from proofline.session import ship

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of ``proofline.plans``; each has QUERIES: name -> (query, DuckDB SQL or None).
PLANS = ("dataset", "shift", "assurance", "representation", "runs", "streams", "reports", "evidence", "gates", "inspection")


def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for plan in PLANS:
        found |= importlib.import_module(f"proofline.plans.{plan}").QUERIES
    return found


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicate findings of the documents."""
    return dataset.exact_duplicate_findings(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: _shipped(query) for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
