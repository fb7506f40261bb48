"""The registry of queries, and the frames that they share: sessions, ticks, daily bars and session series from the given tables.

For each frame there is the same frame in DuckDB SQL (`CTE`), from which the oracles are put together.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import FEDERAL, MARKET
from tidemark.operators import calendar
from tidemark.operators.rolling import by, log_return
from tidemark.sources import schedule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CTE: dict[str, str] = {}
#: In SQL: the first and the last traded day.
FIRST, LAST = "(SELECT lo FROM span)", "(SELECT hi FROM span)"


def query(name: str, body: str | None = None):
    """Registers a query and, put after the frames that it names, its SQL."""

    def keep(f):
        QUERIES[name] = f
        if body is not None:
            ORACLE[name] = with_frames(body)
        return f

    return keep


def with_frames(body: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in needed and CTE[name] is not text and re.search(rf"\b{name}\b", text):
                visit(CTE[name])
                needed.append(name)

    visit(body)
    return ("WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in needed) + " " if needed else "") + body


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c: Column | str, name: str | None = None, places: int = 6) -> Column:
    """A double as the oracle compares it."""
    return F.round(F.col(c) if isinstance(c, str) else c, places).alias(name or c)


def open_sql(rules, d: str = "date") -> str:
    fixed, friday, floating, easter = rules
    falls = lambda k, some: "(" + " OR ".join(f"(strftime({d} + {k}, '%m-%d') = '{x}' AND year({d} + {k}) >= {fixed[x]})" for x in some) + ")"
    nth = " OR ".join(f"(month({d}) = {m} AND isodow({d}) = {w + 1} AND {f'day({d}) > 24' if n == 0 else f'(day({d}) + 6) // 7 = {n}'} AND year({d}) >= {since})" for m, w, n, since in floating)
    observed = f"{falls(0, fixed)} OR (isodow({d}) = 5 AND {falls(1, friday)}) OR (isodow({d}) = 1 AND {falls(-1, fixed)})"
    if easter:
        a, m = f"(year({d}) % 19)", f"((19 * (year({d}) % 19) + 24) % 30)"
        e = f"((2 * (year({d}) % 4) + 4 * (year({d}) % 7) + 6 * {m} + 5) % 7)"
        observed += f" OR {d} = make_date(year({d}), 3, 20) + CAST({m} + {e} - CASE WHEN {e} = 6 AND ({m} = 29 OR ({m} = 28 AND {a} > 10)) THEN 7 ELSE 0 END AS INT)"
    shut = f" OR {d} IN ({', '.join(f'DATE {x!r}' for x in schedule.CLOSURES)})" if rules is MARKET else ""
    return f"(isodow({d}) < 6 AND NOT ({observed} OR {nth}{shut}))"


def _map_sql(spine: str, rules) -> str:
    return f"SELECT date, min(own) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_on_or_after, min(own) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_after FROM (SELECT date, CASE WHEN {open_sql(rules)} THEN date END AS own FROM {spine})"


EARLY = "(strftime(date, '%m-%d') IN ('07-03', '12-24') OR (month(date) = 11 AND isodow(date) = 5 AND day(date) BETWEEN 23 AND 29))"
CLOSE = f"timezone('America/New_York', CAST(date AS TIMESTAMP) + CASE WHEN {EARLY} THEN INTERVAL 13 HOUR ELSE INTERVAL 16 HOUR END)"
_TICK = "ok, ln, pk, sk, ep"
CTE["span"] = "SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem"
_RANGE = "SELECT CAST(unnest(generate_series(CAST(date_trunc('month', lo) - INTERVAL 1 MONTH AS DATE), CAST(date_trunc('month', hi) + INTERVAL {} MONTH AS DATE) - 1, INTERVAL 1 DAY)) AS DATE) AS date FROM "
CTE["spine"] = _RANGE.format(6) + "(SELECT min(x) AS lo, max(x) AS hi FROM (SELECT CAST(l_shipdate AS DATE) AS x FROM lineitem UNION ALL SELECT CAST(o_orderdate AS DATE) FROM orders))"
CTE["spine24"] = _RANGE.format(3) + "(SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events)"
CTE["sessions"] = f"SELECT date AS session_date, row_number() OVER (ORDER BY date) AS idx, epoch({CLOSE}) AS close_s FROM spine WHERE {open_sql(MARKET)}"
CTE["sessions24"] = f"SELECT date AS session_date, epoch({CLOSE}) AS close_s FROM spine24 WHERE {open_sql(MARKET)}"
CTE["daymap"] = _map_sql("spine", MARKET)
CTE["daymap24"] = _map_sql("spine24", MARKET)
CTE["fedmap"] = _map_sql("spine", FEDERAL)
CTE["ticks"] = "SELECT l_returnflag || l_linestatus AS k, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS q, l_extendedprice / l_quantity * (1 - l_discount) AS adj, l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS ep FROM lineitem"
CTE["bars"] = f"SELECT k, date, first(price ORDER BY {_TICK}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {_TICK}) AS close, sum(q) AS volume FROM ticks GROUP BY k, date"
CTE["series"] = f"SELECT k, next_on_or_after AS date, first(price ORDER BY t.date, {_TICK}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY t.date, {_TICK}) AS close, sum(q) AS volume, last(adj ORDER BY t.date, {_TICK}) AS adj_close FROM ticks t JOIN daymap m ON t.date = m.date GROUP BY k, next_on_or_after"
CTE["rets"] = "SELECT *, row_number() OVER w AS idx, ln(close / lag(close) OVER w) AS y FROM series WINDOW w AS (PARTITION BY k ORDER BY date)"
CTE["signals"] = "SELECT ['AF','AO','NF','NO','RF','RO'][CAST(o_orderkey % 6 AS INT) + 1] AS k, CAST(o_orderdate AS DATE) AS ref_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) AS avail, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v1, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS v2, o_orderkey AS id FROM orders"


#: What was read of a set of tables once: its range of days, and its calendars (a row a day).
_KNOWN: dict[tuple, object] = {}
#: Tables and their day columns by calendar, and the whole months that it goes on after the last of them.
_DATED = {"spine": ((("lineitem", "l_shipdate"), ("orders", "o_orderdate")), 6), "spine24": ((("events", "ts"),), 3)}


def once(spark: SparkSession, d: str, what: str, make: Callable):
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _KNOWN:
        _KNOWN[key] = make()
    return _KNOWN[key]


def _range(spark: SparkSession, d: str, *dated: tuple[str, str]) -> tuple[date, date]:
    """The first and the last day of dated columns; an empty set of tables has the day 2000-01-03."""
    ends = reduce(DataFrame.union, (table(spark, d, t).agg(F.min(F.col(c).cast("date")).alias("lo"), F.max(F.col(c).cast("date")).alias("hi")) for t, c in dated))
    lo, hi = ends.agg(F.min("lo"), F.max("hi")).first()
    return lo or date(2000, 1, 3), hi or date(2000, 1, 3)


def traded(spark: SparkSession, d: str) -> tuple[date, date]:
    """The first and the last traded day."""
    return once(spark, d, "traded", lambda: _range(spark, d, ("lineitem", "l_shipdate")))


def _months(day: date, n: int) -> date:
    """The first day of the month n months on."""
    m = day.year * 12 + day.month - 1 + n
    return date(m // 12, m % 12 + 1, 1)


def days(spark: SparkSession, d: str, name: str = "spine") -> DataFrame:
    """The schedule (date, is_open, close_ts, reason) of every day of the tables' own range in whole months: a row a day, made once."""

    def make():
        dated, more = _DATED[name]
        lo, hi = _range(spark, d, *dated)
        first, last = _months(lo, -1), _months(hi, more) - timedelta(1)
        told = schedule.from_rules(calendar.calendar_spine(spark, str(first), str(last))).unionByName(schedule.closures(spark))
        return schedule.within(schedule.latest(told), first, last).drop("version").withColumnRenamed("day", "date").orderBy("date").toArrow()

    return spark.createDataFrame(once(spark, d, name, make))


def last_day(spark: SparkSession, d: str, name: str = "spine") -> date:
    """The last day of the calendar."""
    days(spark, d, name)
    return _KNOWN[spark.sparkContext.applicationId, d, name]["date"][-1].as_py()


def _calendar(spark: SparkSession, d: str, name: str, kind: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return spark.createDataFrame(once(spark, d, f"{name} {kind}", lambda: make(days(spark, d, name)).orderBy("date" if kind != "sessions" else "session_date").toArrow()))


def sessions(spark: SparkSession, d: str, name: str = "spine") -> DataFrame:
    """session_date, close_ts, idx."""
    return _calendar(spark, d, name, "sessions", calendar.trading_sessions)


def session_map(spark: SparkSession, d: str, name: str = "spine") -> DataFrame:
    """date, next_on_or_after, next_after, close_ts."""
    return _calendar(spark, d, name, "session map", calendar.session_day_map)


def business_map(spark: SparkSession, d: str) -> DataFrame:
    """date, next_on_or_after, next_after among federal business days."""
    return _calendar(spark, d, "spine", "business map", lambda x: calendar.day_map(x.select("date"), calendar.business_days(x), "date"))


def ticks(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("k"), F.col("l_shipdate").cast("date").alias("date"), price.alias("price"), F.col("l_quantity").alias("q"), (price * (1 - F.col("l_discount"))).alias("adj"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))


def ohlc(rows: DataFrame, keys: list[str], seq: list[str], *more: Column) -> DataFrame:
    """Open, high, low, close, volume and adjusted close of each group, in the order of seq."""
    at = F.struct(*seq)
    return rows.groupBy(*keys).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("q").alias("volume"), F.max_by("adj", at).alias("adj_close"), *more)


def bars(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    return ohlc(ticks(spark, d), ["k", "date"], ["seq"], *more)


def series(spark: SparkSession, d: str) -> DataFrame:
    """Bars by session: what trades on a closed day counts for the next session."""
    to = session_map(spark, d).select("date", "next_on_or_after")
    moved = ticks(spark, d).join(F.broadcast(to), "date").withColumnsRenamed({"date": "day", "next_on_or_after": "date"})
    return ohlc(moved, ["k", "date"], ["day", "seq"])


def rets(spark: SparkSession, d: str) -> DataFrame:
    """Series with idx and the log return y."""
    w = by("k")
    return series(spark, d).withColumn("idx", F.row_number().over(w).cast("long")).withColumn("y", log_return("close", w))


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Published values with a reference date and, some days later, an availability date."""
    key = F.col("o_orderkey")
    name = F.element_at(F.array(*map(F.lit, ("AF", "AO", "NF", "NO", "RF", "RO"))), (key % 6).cast("int") + 1)
    ref = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(name.alias("k"), ref.alias("ref_date"), F.date_add(ref, (key % 5).cast("int")).alias("avail"), F.when(key % 7 != 0, F.col("o_totalprice")).alias("v1"), F.when(key % 3 != 0, F.col("o_custkey").cast("double")).alias("v2"), key.alias("id"))
