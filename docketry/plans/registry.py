"""All registered queries of the evidence operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("search_queries", "text_queries", "metadata_queries", "evidence_queries", "graph_queries", "source_queries", "pipeline_queries", "store_queries", "acquisition_queries")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"docketry.plans.{name}"), attribute).items():
            if key in out:
                raise ValueError(f"query {key} is registered twice")
            out[key] = value
    return out


def queries() -> dict[str, Query]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
