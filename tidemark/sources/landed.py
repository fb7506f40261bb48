"""Landed source tables into daily series: one row a key and day, missing values as NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import clean


def doubles_clean(df: DataFrame) -> DataFrame:
    """df with NaN turned into NULL in every double column."""
    return df.select(*(clean(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of each key the row that landed last; rows with a null key are left out."""
    rest = [c for c in df.columns if c not in keys]
    last = df.dropna(subset=keys).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(seq)).alias("__r"))
    return last.select(*(F.col(c) if c in keys else F.col(f"__r.{c}") for c in df.columns))


def inventory(sources: dict[str, tuple[DataFrame | None, str, bool]]) -> DataFrame:
    """source, n_rows, first_date, last_date of each source that is there; a required one that isn't raises."""
    missing = [n for n, (df, _, required) in sources.items() if df is None and required]
    if missing:
        raise ValueError(f"required sources are missing: {missing}")
    parts = [df.agg(F.lit(n).alias("source"), F.count("*").alias("n_rows"), F.min(F.col(c).cast("date")).alias("first_date"), F.max(F.col(c).cast("date")).alias("last_date")) for n, (df, c, _) in sources.items() if df is not None]
    return reduce(DataFrame.unionByName, parts)


def prefixed(df: DataFrame, name: str) -> DataFrame:
    """Lower-case columns; with a close the prices are prefixed, else the one value column takes the name."""
    low = df.toDF(*(c.lower().strip() for c in df.columns))
    values = [c for c in low.columns if c != "date"]
    if "close" in values:
        return low.select("date", *(F.col(c).alias(f"{name}_{c}") for c in ("open", "high", "low", "close") if c in values))
    if len(values) != 1:
        raise ValueError(f"neither prices nor one value: {values}")
    return low.select("date", F.col(values[0]).alias(name))


def backfilled(primary: DataFrame, secondary: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Full merge with the primary's value where it has one, and <column>_source."""
    a, b = primary.select(*keys, F.col(column).alias("__a")), secondary.select(*keys, F.col(column).alias("__b"))
    source = F.when(F.col("__a").isNotNull(), "primary").when(F.col("__b").isNotNull(), "secondary")
    return a.join(b, keys, "full").select(*keys, F.coalesce("__a", "__b").alias(column), source.alias(f"{column}_source"))


def from_ymd(df: DataFrame, seq: str) -> DataFrame:
    """date and value from year, month and day numbers; impossible dates are left out, the last row of a date stays."""
    date = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int")), F.lit("yyyy-MM-dd")).cast("date")
    return keep_last(df.withColumn("date", date), ["date"], seq).select("date", "value")


def columnar_blocks(df: DataFrame, column: str, fields: list[str], keep: list[str]) -> DataFrame:
    """Rows from JSON objects that hold one array for each field."""
    schema = T.StructType([T.StructField(f, T.ArrayType(T.StringType())) for f in fields])
    parsed = df.select(*keep, F.from_json(column, schema).alias("j"))
    return parsed.select(*keep, F.explode(F.arrays_zip(*(F.col(f"j.{f}") for f in fields))).alias("z")).select(*keep, *(F.col(f"z.{f}") for f in fields))


def timeline(points: DataFrame, keys: list[str], tone: bool = False) -> DataFrame:
    """A row a day from stamped points: sums (of tone: the mean) and norms. A missing value makes its day missing, a missing norm counts 0."""
    day = F.to_date(F.substring(F.regexp_replace("stamp", "[^0-9]", ""), 1, 8), "yyyyMMdd")
    out = points.groupBy(*keys, day.alias("date")).agg(F.when(F.count_if(F.col("value").isNull()) == 0, F.sum("value")).alias("value"), F.coalesce(F.sum("norm"), F.lit(0)).alias("norm"), F.count("*").alias("n"))
    return out.withColumn("value", F.col("value") / F.col("n")) if tone else out


def fallback(sources: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """For each key the row of the first source that has it, with `source`."""
    parts = [df.withColumn("source", F.lit(n)).withColumn("__p", F.lit(i)) for i, (n, df) in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rest = [c for c in both.columns if c not in keys and c != "__p"]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), "__p").alias("__r")).select(*keys, "__r.*")


def tail_of(cache: DataFrame, new: DataFrame, keys: list[str], norm: str, overlap: int) -> DataFrame:
    """The part of `new` from `overlap` days before the last covered day of each key in the cache on."""
    last = cache.where(F.col(norm) > 0).groupBy(*keys).agg(F.date_sub(F.max("date"), overlap).alias("__lo"))
    return new.join(last, keys).where("date >= __lo").drop("__lo")
