"""Every query of the library outside the llm subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import audit, checks, evaluation, features, market
from tidemark.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "audit", "checks", "evaluation", "features", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.feature_table(spark, sf_dir)
