"""Rolling-origin forecast windows over indexed series (keys, idx, date, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def indexed(df: DataFrame, keys: list[str], order: str = "date") -> DataFrame:
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))


def split_by_rows(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """part: 'validation' for the last `rows` rows of each series, else 'train'."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("part", F.when(F.col("idx") > n - rows, "validation").otherwise("train"))


def split_by_fraction(df: DataFrame, keys: list[str], fraction: float, horizon: int) -> DataFrame:
    """The same for a share of the rows, halves rounded to even, of at least four horizons."""
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = F.greatest(F.lit(4 * horizon), F.bround(n * F.lit(fraction), 0).cast("long"))
    return df.withColumn("part", F.when(F.col("idx") > n - rows, "validation").otherwise("train"))


def origins(df: DataFrame, keys: list[str], horizon: int, stride: int, most: int | None = None) -> DataFrame:
    """keys, window, origin (the last context row): each stretch of rows given by `keys` is cut from its first row on, while a whole horizon is left; all of them, or the earliest `most`."""
    w = Window.partitionBy(*keys)
    placed = df.withColumn("lo", F.min("idx").over(w)).withColumn("hi", F.max("idx").over(w))
    start = F.col("idx") - F.col("lo")
    first = placed.where((start % stride == 0) & (F.col("idx") + horizon - 1 <= F.col("hi")))
    first = first if most is None else first.where(start / stride < most)
    return first.select(*keys, (start / stride).cast("long").alias("window"), (F.col("idx") - 1).alias("origin"))


def targets(windows: DataFrame, series: DataFrame, keys: list[str], horizon: int, value: str) -> DataFrame:
    """A row for each window and step ahead, with the actual value."""
    ahead = windows.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("idx", F.col("origin") + F.col("horizon"))
    rows = ahead.join(series.select(*keys, "idx", "date", F.col(value).alias("actual")), [*keys, "idx"])
    return rows.join(series.select(*keys, F.col("idx").alias("origin"), F.col("date").alias("forecast_origin")), [*keys, "origin"])


def context(df: DataFrame, keys: list[str], columns: list[str], rows: int) -> DataFrame:
    """df with, for each column, the array of its last `rows` values; nulls keep their places."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(1 - rows, 0)
    held = F.collect_list(F.struct(*columns)).over(w)
    return df.withColumn("__held", held).withColumns({f"{c}_context": F.expr(f"transform(__held, s -> s.{c})") for c in columns}).drop("__held")


def future(df: DataFrame, keys: list[str], columns: list[str], horizon: int) -> DataFrame:
    """keys, idx and, for each known-future column, the array of the next `horizon` values; rows with a missing one are rejected."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(1, horizon)
    held = df.withColumn("__held", F.collect_list(F.struct(*columns)).over(w))
    whole = " and ".join(f"s.{c} is not null" for c in columns)
    held = held.where((F.size("__held") == horizon) & F.expr(f"forall(__held, s -> {whole})"))
    return held.select(*keys, "idx", *(F.expr(f"transform(__held, s -> s.{c})").alias(f"{c}_future") for c in columns))
