"""The exchange's schedule as a table: version, day, is_open, close_ts (UTC), reason. Rules fill the days that no table tells.

A day may stand in several versions; the latest that was known counts. A range that the schedule does not cover day by day is
refused, so that a missing day can never be taken for a closed one.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import MARKET, close_instant, closes_early, is_open

COLUMNS = "version int, day date, is_open boolean, close_ts timestamp, reason string"

#: Days on which the exchange stayed closed outside its rules.
CLOSURES = ("1985-09-27", "1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")


def from_rules(spine: DataFrame, version: int = 0) -> DataFrame:
    """A schedule for the days of the spine by the market's rules. reason: weekend, holiday, early or session."""
    day = F.col("date")
    opened = is_open(day, MARKET)
    reason = F.when(F.weekday(day) > 4, "weekend").when(~opened, "holiday").when(closes_early(day), "early").otherwise("session")
    return spine.select(F.lit(version).alias("version"), day.alias("day"), opened.alias("is_open"), F.when(opened, close_instant(day)).alias("close_ts"), reason.alias("reason"))


def closures(spark: SparkSession, days: tuple[str, ...] = CLOSURES, version: int = 1) -> DataFrame:
    """A schedule of days that are closed against the rules."""
    return spark.createDataFrame([(version, date.fromisoformat(d), False, None, "closure") for d in days], COLUMNS)


def latest(schedule: DataFrame, as_of: int | None = None) -> DataFrame:
    """One row a day: that of the highest version, or of the highest up to `as_of`."""
    known = schedule if as_of is None else schedule.where(F.col("version") <= as_of)
    rest = F.struct("version", "is_open", "close_ts", "reason")
    return known.groupBy("day").agg(F.max_by(rest, "version").alias("r")).select("r.version", "day", "r.is_open", "r.close_ts", "r.reason")


def within(schedule: DataFrame, first: date, last: date) -> DataFrame:
    """The days from first to last; raises unless each of them stands in the schedule once."""
    days = schedule.where(F.col("day").between(F.lit(first), F.lit(last)))
    n, apart = days.agg(F.count("*"), F.count_distinct("day")).first()
    due = (last - first).days + 1
    if n != apart:
        raise ValueError(f"{n - apart} days stand more than once in the schedule")
    if n != due:
        raise ValueError(f"the schedule has {n} of the {due} days from {first} to {last}")
    return days


def write(schedule: DataFrame, path: str) -> None:
    """Adds the rows to the schedule at path, one folder a version."""
    schedule.write.mode("append").partitionBy("version").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLUMNS).parquet(path).select("version", "day", "is_open", "close_ts", "reason")
