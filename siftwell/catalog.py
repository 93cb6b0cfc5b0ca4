"""All queries outside the training-data folder, with their DuckDB SQL where SQL can say them."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Each module has ``QUERIES``: name -> (query, SQL or None).
MODULES = [
    "siftwell.plans.text_queries",
    "siftwell.plans.join_queries",
    "siftwell.plans.ranking_queries",
    "siftwell.plans.aggregate_queries",
    "siftwell.plans.window_queries",
    "siftwell.plans.evidence_queries",
    "siftwell.plans.reference_queries",
    "siftwell.plans.layout_queries",
    "siftwell.plans.policy_queries",
    "siftwell.plans.contract_queries",
]


def _all() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= import_module(module).QUERIES
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwell.plans.ranking_queries import retrieval

    return retrieval(spark, sf_dir)


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
