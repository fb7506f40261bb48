"""Audits: one unpivot and one aggregation for all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melted(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """ids, column, value: a row for each cell."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns)))
    return df.select(*ids, cells.alias("__c")).select(*ids, "__c.*")


def column_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    return melted(df, [], columns).groupBy("column").agg(F.count("*").alias("n_rows"), (1 - F.count("value") / F.count("*")).alias("missing_share"), F.min("value").alias("low"), F.max("value").alias("high"), (F.coalesce(F.min("value") == F.max("value"), F.lit(True))).alias("is_constant"))


def pairwise_corr(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Correlation of each pair of columns over the rows that have both."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs)))
    return df.select(cells.alias("c")).select("c.*").where("x is not null and y is not null").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"), F.count("*").alias("n"))


def flags(df: DataFrame, key: str, entity: str, hit: Column, prefix: str) -> DataFrame:
    """key and, for each entity that has a hit anywhere, <prefix><entity>: 1 where it has one, else 0. Entities are few: each is a column."""
    marked = df.select(key, F.col(entity).cast("string").alias("__e"), hit.alias("__hit"))
    names = sorted(r[0] for r in marked.where("__hit").select("__e").distinct().collect())
    return marked.groupBy(key).agg(*(F.max(F.when((F.col("__e") == n) & F.col("__hit"), 1).otherwise(0)).alias(f"{prefix}{n}") for n in names))
