"""Scoring of quantile forecasts. Rows: keys, model, window, horizon, actual, q (array aligned with levels), prediction."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import pinball, ratio

#: Quantile levels of a forecast (fixed values).
LEVELS = [0.01, *(round(0.05 * k, 2) for k in range(1, 20)), 0.99]
Z = [NormalDist().inv_cdf(p) for p in LEVELS]


def gaussian_quantiles(sigma: Column) -> Column:
    """Quantiles of a zero-mean normal forecast, the same for each step ahead."""
    return F.transform(F.array(*map(F.lit, Z)), lambda z: sigma * z)


def level(q: Column | str, p: float) -> Column:
    return F.element_at(q, LEVELS.index(p) + 1)


def with_errors(df: DataFrame) -> DataFrame:
    low, high, error = level("q", 0.1), level("q", 0.9), F.col("prediction") - F.col("actual")
    return df.withColumns(
        {
            "error": error,
            "abs_error": F.abs(error),
            "squared_error": error * error,
            "correct_direction": ((F.col("prediction") >= 0) == (F.col("actual") >= 0)).cast("int"),
            "interval_hit": F.col("actual").between(low, high).cast("int"),
            "interval_width": high - low,
            "tail_hit": F.col("actual").between(level("q", 0.01), level("q", 0.99)).cast("int"),
            "pinball": pinball(LEVELS, F.col("q"), F.col("actual")),
        }
    )


def metric_columns() -> list[Column]:
    """Aggregates over rows of with_errors."""
    mean = {"mae": "abs_error", "bias": "error", "directional_accuracy": "correct_direction", "mean_prediction": "prediction", "mean_actual": "actual", "coverage": "interval_hit", "tail_coverage": "tail_hit", "width": "interval_width", "mean_pinball": "pinball"}
    return [F.count("*").alias("n_rows"), F.sqrt(F.avg("squared_error")).alias("rmse"), *(F.avg(c).alias(n) for n, c in mean.items()), (2 * ratio(F.avg("pinball"), F.avg(F.abs("actual")))).alias("wql")]


def metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """By keys and step ahead, and over all steps ('overall'), in one pass."""
    rows = df.groupingSets([[F.col(k) for k in [*keys, "horizon"]], [F.col(k) for k in keys]], *(F.col(k) for k in [*keys, "horizon"]))
    out = rows.agg(F.grouping("horizon").alias("__all"), *metric_columns())
    return out.withColumn("horizon", F.when(F.col("__all") == 1, "overall").otherwise(F.col("horizon").cast("string"))).drop("__all")


def window_wql(df: DataFrame, keys: list[str], denominator: list[str]) -> DataFrame:
    """WQL of each window (keys, window). The mean absolute actual is taken over `denominator`: the fold, or the window's own keys."""
    loss = pinball(LEVELS, F.col("q"), F.col("actual"))
    sums = df.groupBy(*dict.fromkeys([*denominator, *keys, "window"])).agg(F.avg(loss).alias("__l"), F.sum(F.abs("actual")).alias("__a"), F.count("actual").alias("__n"))
    own = Window.partitionBy(*denominator)  # of rows that are one a window by now
    scale = ratio(F.sum("__a").over(own), F.sum("__n").over(own))
    return sums.select(*keys, "window", (2 * ratio(F.col("__l"), scale)).alias("wql"))


def crossings(q: Column, tolerance: float = 1e-8) -> Column:
    """Steps down between neighbouring quantiles."""
    steps = F.zip_with(F.slice(q, 2, len(LEVELS) - 1), F.slice(q, 1, len(LEVELS) - 1), lambda b, a: b - a)
    return F.size(F.filter(steps, lambda d: d < -tolerance))
