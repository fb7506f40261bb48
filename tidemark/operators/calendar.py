"""Sessions and the day maps derived from them. A calendar has one row a day, whatever the number of series: small and broadcast."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import FEDERAL, MARKET, close_instant, is_open


def calendar_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every day from start to end."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))


def trading_sessions(spine: DataFrame) -> DataFrame:
    """session_date, close_ts, idx of the open days: as a schedule tells (date, is_open, close_ts), or by the market's rules."""
    told = {"is_open", "close_ts"} <= set(spine.columns)
    days = spine.where(F.col("is_open") if told else is_open(F.col("date"), MARKET))
    close = F.col("close_ts") if told else close_instant(F.col("date"))
    return days.select(F.col("date").alias("session_date"), close.alias("close_ts"), F.row_number().over(Window.orderBy("date")).cast("long").alias("idx"))


def business_days(spine: DataFrame) -> DataFrame:
    return spine.where(is_open(F.col("date"), FEDERAL))


def day_map(spine: DataFrame, days: DataFrame, day: str = "session_date") -> DataFrame:
    """For each day of the spine: next_on_or_after and next_after among `days` (NULL past the end)."""
    marked = spine.join(days.select(F.col(day).alias("date"), F.lit(True).alias("open")), "date", "left")
    later = Window.orderBy("date")
    own = F.when(F.col("open"), F.col("date"))
    return marked.select("date", F.min(own).over(later.rowsBetween(0, Window.unboundedFollowing)).alias("next_on_or_after"), F.min(own).over(later.rowsBetween(1, Window.unboundedFollowing)).alias("next_after"))


def session_day_map(spine: DataFrame) -> DataFrame:
    sessions = trading_sessions(spine)
    return day_map(spine, sessions).join(F.broadcast(sessions.select(F.col("session_date").alias("next_on_or_after"), "close_ts")), "next_on_or_after", "left").select("date", "next_on_or_after", "next_after", "close_ts")


def third_friday(day: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "month"), 1), "Fri"), 14)


def opex_days(sessions: DataFrame) -> DataFrame:
    """Of each month the last session on or before its third Friday."""
    due = sessions.where(F.col("session_date") <= third_friday(F.col("session_date")))
    return due.groupBy(F.trunc("session_date", "month").alias("month")).agg(F.max("session_date").alias("opex_day"))


def event_calendar(sessions: DataFrame, events: DataFrame, start: date, end: date) -> DataFrame:
    """The calendar of the sessions from start to end; built over all sessions, so that months at its ends are whole, then cut."""
    s = sessions.select(F.col("session_date").alias("date"))
    opex = opex_days(sessions).select(F.col("opex_day").alias("date"), F.lit(1).alias("is_opex_day"))
    week = opex.select(F.date_trunc("week", "date").cast("date").alias("week"), F.lit(1).alias("is_opex_week"))
    flags = events.select("date").distinct().withColumn("is_event_day", F.lit(1))
    order, month = Window.orderBy("date"), Window.partitionBy(F.trunc("date", "month"))
    out = s.join(opex, "date", "left").withColumn("week", F.date_trunc("week", "date").cast("date")).join(F.broadcast(week), "week", "left").join(flags, "date", "left").fillna(0, ["is_opex_day", "is_opex_week", "is_event_day"])
    last = F.max(F.when(F.col("is_event_day") == 1, F.col("date"))).over(order)
    nxt = F.min(F.when(F.col("is_event_day") == 1, F.col("date"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    first_pos, last_pos = F.row_number().over(month.orderBy("date")), F.row_number().over(month.orderBy(F.desc("date")))
    gap = F.datediff(F.lead("date").over(order), "date")
    out = out.select(
        "date",
        "is_event_day",
        F.datediff(nxt, "date").alias("days_to_event"),
        F.datediff("date", last).alias("days_since_event"),
        F.coalesce(F.lead("is_event_day").over(order), F.lit(0)).alias("is_event_day_before"),
        F.least(F.floor(F.datediff("date", last) / 7), F.lit(5)).alias("cycle_week"),
        (last_pos == 1).cast("int").alias("is_month_end"),
        ((last_pos == 1) & (F.month("date") % 3 == 0)).cast("int").alias("is_quarter_end"),
        F.when(first_pos <= 3, first_pos - 1).when(last_pos <= 3, -last_pos).alias("turn_of_month"),
        (last_pos - 1).alias("days_to_month_end"),
        "is_opex_day",
        "is_opex_week",
        (F.col("is_opex_day") * (F.month("date") % 3 == 0).cast("int")).alias("is_quad_witching"),
        F.weekday("date").alias("day_of_week"),
        F.coalesce((gap > F.when(F.weekday("date") == 4, 3).otherwise(1)).cast("int"), F.lit(0)).alias("is_pre_holiday"),
    )
    return out.where(F.col("date").between(F.lit(start), F.lit(end)))
