"""All queries of the engine by name, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import assembly, discovery, engine, figures, geometry, language, more, periods, reading, readings, selection, selection_facts, text_facts, writing  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping program resolved over all companies and quarters."""
    return QUERIES["h0_mapping_program"](spark, sf_dir)
