"""Registered queries and their DuckDB SQL, gathered from the plan modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bayes_plans, dialog_plans, findings_plans, graph_plans, ingest_plans, lab_plans, page_plans, source_plans, span_plans, stream_plans, trend_plans  # noqa: F401
from .base import REGISTRY


def queries() -> dict:
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for name, (_, sql) in REGISTRY.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REGISTRY["flagship"][0](spark, sf_dir)
