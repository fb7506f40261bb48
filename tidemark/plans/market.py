"""Sources, calendar, alignment, series features and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import FEDERAL, MARKET, ratio
from tidemark.operators import align, calendar, rolling
from tidemark.operators.rolling import by, ffill, log_return, pct_change
from tidemark.operators.rolling import rolling as over
from tidemark.plans.base import CLOSE, CTE, EARLY, FIRST, LAST, bars, business_map, days, last_day, open_sql, query, r, rets, series, session_map, sessions, signals, table, ticks, traded
from tidemark.sources import landed, schedule


# sources ---------------------------------------------------------------------------------------------------------------


@query("dedup_keep_last", "SELECT k, date, price, q AS volume FROM ticks QUALIFY row_number() OVER (PARTITION BY k, date ORDER BY ok DESC, ln DESC, pk DESC, sk DESC, ep DESC) = 1")
def dedup_keep_last(spark, d):
    return landed.keep_last(ticks(spark, d), ["k", "date"], "seq").select("k", "date", "price", F.col("q").alias("volume"))


@query("source_inventory", "SELECT 'orders' AS source, count(*) AS n_rows, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date FROM orders UNION ALL SELECT 'lineitem', count(*), min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)) FROM lineitem UNION ALL SELECT 'events', count(*), min(CAST(ts AS DATE)), max(CAST(ts AS DATE)) FROM events")
def source_inventory(spark, d):
    return landed.inventory({"orders": (table(spark, d, "orders"), "o_orderdate", True), "lineitem": (table(spark, d, "lineitem"), "l_shipdate", True), "events": (table(spark, d, "events"), "ts", False), "rates": (None, "date", False)})


@query("bars_daily", "SELECT k, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars")
def bars_daily(spark, d):
    return bars(spark, d).select("k", "date", *map(r, ("open", "high", "low", "close")), "volume")


@query("normalize_index", "SELECT date, round(open, 6) AS af_open, round(high, 6) AS af_high, round(low, 6) AS af_low, round(close, 6) AS af_close FROM bars WHERE k = 'AF'")
def normalize_index(spark, d):
    raw = bars(spark, d).where("k = 'AF'").select(F.col("date").alias("DATE"), *(F.col(c).alias(c.upper()) for c in ("open", "high", "low", "close")))
    return landed.prefixed(raw, "af").select("date", *(r(f"af_{c}") for c in ("open", "high", "low", "close")))


@query("backfill_sources", "SELECT date, round(coalesce(a.close, b.close), 6) AS close, CASE WHEN a.close IS NOT NULL THEN 'primary' ELSE 'secondary' END AS close_source FROM (SELECT date, close FROM bars WHERE k = 'NF') a FULL JOIN (SELECT date, close FROM bars WHERE k = 'NO') b USING (date)")
def backfill_sources(spark, d):
    a, b = (bars(spark, d).where(F.col("k") == k).select("date", "close") for k in ("NF", "NO"))
    return landed.backfilled(a, b, ["date"], "close").select("date", r("close"), "close_source")


@query("ymd_series", "SELECT date, round(arg_max(v, id), 6) AS value FROM (SELECT try_cast(printf('%04d-%02d-%02d', CAST(year(o_orderdate) AS INT), CAST(month(o_orderdate) AS INT), CAST(day(o_orderdate) + (o_orderkey % 4) AS INT)) AS DATE) AS date, o_totalprice AS v, o_orderkey AS id FROM orders) WHERE date IS NOT NULL GROUP BY date")
def ymd_series(spark, d):
    o = F.col("o_orderdate")
    raw = table(spark, d, "orders").select(F.year(o).alias("year"), F.month(o).alias("month"), (F.dayofmonth(o) + F.col("o_orderkey") % 4).alias("day"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))
    return landed.from_ymd(raw, "seq").select("date", r("value"))


@query("cross_asset_wide", "SELECT date, " + ", ".join(f"round(max(CASE WHEN k = '{k}' THEN close END), 6) AS {k.lower()}_close, round(max(CASE WHEN k = '{k}' THEN y END), 6) AS {k.lower()}_log_ret" for k in ("AF", "NO", "RF")) + " FROM rets WHERE k IN ('AF', 'NO', 'RF') GROUP BY date")
def cross_asset_wide(spark, d):
    names = ["AF", "NO", "RF"]
    wide = rets(spark, d).groupBy("date").pivot("k", names).agg(F.max("close").alias("close"), F.max("y").alias("log_ret"))
    return wide.select("date", *(r(f"{k}_{c}", f"{k.lower()}_{c}") for k in names for c in ("close", "log_ret"))).where(" or ".join(f"{k.lower()}_close is not null" for k in names))


@query("flatten_columnar_json", "SELECT CAST(event_id AS VARCHAR) AS accession, event_type AS form, CAST(ts AS DATE) AS filed, CAST(user_id % 10 AS BIGINT) AS entity FROM events")
def flatten_columnar_json(spark, d):
    e = table(spark, d, "events").withColumn("entity", F.col("user_id") % 10).withColumn("page", F.floor(F.col("event_id") / 1000))  # blocks of a bounded size
    fields = {"accession": F.col("event_id").cast("string"), "form": F.col("event_type"), "filed": F.col("ts").cast("date").cast("string")}
    held = F.collect_list(F.struct(*(c.alias(n) for n, c in fields.items())))
    blocks = e.groupBy("entity", "page").agg(held.alias("h")).select("entity", F.to_json(F.struct(*(F.expr(f"transform(h, x -> x.{n})").alias(n) for n in fields))).alias("json"))
    flat = landed.columnar_blocks(blocks, "json", list(fields), ["entity"])
    return landed.keep_last(flat, ["accession"], "filed").select("accession", "form", F.to_date("filed").alias("filed"), "entity")


@query("timeline_daily", "SELECT event_type AS topic, CAST(ts AS DATE) AS date, CASE WHEN count(*) FILTER (v IS NULL) > 0 THEN NULL ELSE round(sum(v), 6) END AS value, CAST(coalesce(sum(n), 0) AS BIGINT) AS norm FROM (SELECT *, CASE WHEN event_id % 97 <> 0 THEN value END AS v, CASE WHEN event_id % 5 <> 0 THEN 1 END AS n FROM events) GROUP BY ALL")
def timeline_daily(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("topic"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"), F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, 1).alias("norm"))
    return landed.timeline(e, ["topic"]).select("topic", "date", r("value"), F.col("norm").cast("long").alias("norm"))


@query("timeline_tone", "SELECT event_type AS topic, CAST(ts AS DATE) AS date, CASE WHEN count(*) FILTER (event_id % 997 = 0) = 0 THEN round(avg(value), 5) END AS value, count(*) AS norm FROM events GROUP BY ALL")
def timeline_tone(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("topic"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"), F.when(F.col("event_id") % 997 != 0, F.col("value")).alias("value"), F.lit(1).alias("norm"))
    return landed.timeline(e, ["topic"], tone=True).select("topic", "date", r("value", places=5), F.col("norm").cast("long").alias("norm"))


@query("calendar_spine", "SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem)")
def calendar_spine(spark, d):
    ends = table(spark, d, "lineitem").agg(F.min(F.col("l_shipdate").cast("date")).alias("lo"), F.max(F.col("l_shipdate").cast("date")).alias("hi"))
    return ends.select(F.explode(F.sequence("lo", "hi")).alias("date"))


@query("fallback_source", "SELECT k, date, round(close, 6) AS close, source FROM (SELECT *, row_number() OVER (PARTITION BY k, date ORDER BY p) AS i FROM (SELECT k, date, close, 'bars' AS source, 1 AS p FROM bars WHERE dayofweek(date) <> 3 UNION ALL SELECT k, date, close, 'sessions', 2 FROM series)) WHERE i = 1")
def fallback_source(spark, d):
    return landed.fallback([("bars", bars(spark, d).where("dayofweek(date) <> 4")), ("sessions", series(spark, d))], ["k", "date"]).select("k", "date", r("close"), "source")


# calendar --------------------------------------------------------------------------------------------------------------

_SPAN = "(SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem)"


def _traded(spark, d, rows, column):
    """Days of a calendar within the traded range."""
    lo, hi = traded(spark, d)
    return rows.where(F.col(column).between(F.lit(lo), F.lit(hi)))


@query("trading_sessions", f"SELECT session_date, CAST(close_s AS BIGINT) AS close_s, idx FROM sessions, {_SPAN} WHERE session_date BETWEEN lo AND hi")
def trading_sessions(spark, d):
    return _traded(spark, d, sessions(spark, d).select("session_date", F.unix_timestamp("close_ts").alias("close_s"), "idx"), "session_date")


@query("session_schedule", f"SELECT date, {open_sql(MARKET)} AS is_open, CASE WHEN {open_sql(MARKET)} THEN CAST(epoch({CLOSE}) AS BIGINT) END AS close_s, CASE WHEN isodow(date) > 5 THEN 'weekend' WHEN date IN ({', '.join(f'DATE {x!r}' for x in schedule.CLOSURES)}) THEN 'closure' WHEN NOT {open_sql(MARKET)} THEN 'holiday' WHEN {EARLY} THEN 'early' ELSE 'session' END AS reason FROM spine")
def session_schedule(spark, d):
    return days(spark, d).select("date", "is_open", F.unix_timestamp("close_ts").alias("close_s"), "reason")


@query("business_days", f"SELECT date FROM spine, {_SPAN} WHERE {open_sql(FEDERAL)} AND date BETWEEN lo AND hi")
def business_days(spark, d):
    return _traded(spark, d, calendar.business_days(days(spark, d).select("date")), "date")


@query("session_day_map", f"SELECT date, next_on_or_after, next_after FROM daymap, {_SPAN} WHERE date BETWEEN lo AND hi")
def session_day_map(spark, d):
    return _traded(spark, d, session_map(spark, d).drop("close_ts"), "date")


CTE["opex"] = "SELECT date_trunc('month', session_date) AS month, max(session_date) AS opex_day FROM sessions WHERE session_date <= CAST(date_trunc('month', session_date) AS DATE) + CAST((5 - isodow(date_trunc('month', session_date)) + 7) % 7 + 14 AS INT) GROUP BY 1"


@query("opex_days", f"SELECT CAST(month AS DATE) AS month, opex_day FROM opex, {_SPAN} WHERE opex_day BETWEEN lo AND hi")
def opex_days(spark, d):
    return _traded(spark, d, calendar.opex_days(sessions(spark, d)), "opex_day")


CTE["evdays"] = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 11 = 0"
CTE["cal0"] = "SELECT session_date AS date, CAST(session_date IN (SELECT opex_day FROM opex) AS INT) AS is_opex_day, CAST(date_trunc('week', session_date) IN (SELECT date_trunc('week', opex_day) FROM opex) AS INT) AS is_opex_week, CAST(session_date IN (SELECT date FROM evdays) AS INT) AS is_event_day FROM sessions"
CTE["cal"] = f"""SELECT date, is_event_day, CAST(nxt - date AS INT) AS days_to_event, CAST(date - lst AS INT) AS days_since_event, coalesce(lead(is_event_day) OVER (ORDER BY date), 0) AS is_event_day_before,
 CAST(least(floor((date - lst) / 7), 5) AS BIGINT) AS cycle_week, CAST(lp = 1 AS INT) AS is_month_end, CAST(lp = 1 AND month(date) % 3 = 0 AS INT) AS is_quarter_end, CASE WHEN fp <= 3 THEN fp - 1 WHEN lp <= 3 THEN -lp END AS turn_of_month, lp - 1 AS days_to_month_end,
 is_opex_day, is_opex_week, is_opex_day * CAST(month(date) % 3 = 0 AS INT) AS is_quad_witching, CAST(isodow(date) - 1 AS INT) AS day_of_week, coalesce(CAST(lead(date) OVER (ORDER BY date) - date > CASE WHEN isodow(date) = 5 THEN 3 ELSE 1 END AS INT), 0) AS is_pre_holiday
 FROM (SELECT *, max(CASE WHEN is_event_day = 1 THEN date END) OVER (ORDER BY date) AS lst, min(CASE WHEN is_event_day = 1 THEN date END) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date) AS fp, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date DESC) AS lp FROM cal0)"""


def _calendar(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderkey % 11 = 0").select(F.col("o_orderdate").cast("date").alias("date"))
    c = calendar.event_calendar(sessions(spark, d), o, *traded(spark, d))
    return c.withColumns({"cycle_week": F.col("cycle_week").cast("long"), "turn_of_month": F.col("turn_of_month").cast("long"), "days_to_month_end": F.col("days_to_month_end").cast("long")})


def _calendar_query(name, *columns):
    cols = ["date", *columns] if columns else ["*"]

    @query(name, f"SELECT {', '.join(cols)} FROM cal WHERE date BETWEEN {FIRST} AND {LAST}")
    def part(spark, d):
        return _calendar(spark, d).select(*cols)


_calendar_query("event_calendar")
_calendar_query("opex_week", "is_opex_week", "is_quad_witching")
_calendar_query("month_end_flags", "is_month_end", "is_quarter_end")
_calendar_query("month_position", "days_to_month_end")
_calendar_query("turn_of_month", "turn_of_month")
_calendar_query("cycle_week", "cycle_week")
_calendar_query("days_to_since_event", "days_to_event", "days_since_event")
_calendar_query("day_before_flag", "is_event_day_before")
_calendar_query("pre_holiday", "is_pre_holiday")


@query("event_flags_coverage", "SELECT date, CASE WHEN date <= (SELECT max(date) FROM evdays) THEN is_event_day END AS is_event_day FROM cal0")
def event_flags_coverage(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderkey % 11 = 0").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    s = sessions(spark, d).select(F.col("session_date").alias("date"))
    flagged = s.join(o.withColumn("hit", F.lit(1)), "date", "left").crossJoin(F.broadcast(o.agg(F.max("date").alias("through"))))  # one row
    return flagged.select("date", F.when(F.col("date") <= F.col("through"), F.coalesce("hit", F.lit(0))).alias("is_event_day"))


@query("next_sessions", "SELECT event_id, step, session_date FROM (SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY session_date) AS INT) AS step, session_date FROM events JOIN sessions24 ON close_s > epoch(ts) AND session_date <= CAST(ts AS DATE) + 16) WHERE step <= 5")
def next_sessions(spark, d):
    s = sessions(spark, d, "spine24")
    numbered = s.select("session_date", "idx")
    at = align.first_close_after(table(spark, d, "events").select("event_id", F.col("ts").alias("accepted"), F.col("ts").cast("date").alias("filed")), session_map(spark, d, "spine24"))
    first = at.join(F.broadcast(numbered.withColumnRenamed("session_date", "available")), "available")
    ahead = first.select("event_id", "idx", F.posexplode(F.sequence(F.col("idx"), F.col("idx") + 4)).alias("p", "j"))
    return ahead.select("event_id", (F.col("p") + 1).alias("step"), F.col("j").alias("idx")).join(F.broadcast(numbered), "idx").select("event_id", "step", "session_date")


# alignment -------------------------------------------------------------------------------------------------------------


def _asof_sql(columns, lag=0, suffix=""):
    parts = " ".join(f"ASOF LEFT JOIN (SELECT k, avail + {lag} AS a, last({c} ORDER BY ref_date, id) AS {c} FROM signals WHERE {c} IS NOT NULL GROUP BY 1, 2) j{i} ON s.k = j{i}.k AND s.date >= j{i}.a" for i, c in enumerate(columns))
    return f"SELECT s.k, s.date, {', '.join(f'round(j{i}.{c}, 6) AS {c}{suffix}' for i, c in enumerate(columns))} FROM series s {parts}"


def _asof(spark, d, columns, **more):
    base = series(spark, d).select("k", "date")
    return align.asof_join(base, signals(spark, d), columns, ["k"], ties=["ref_date", "id"], last=last_day(spark, d), **more)


@query("asof_join", _asof_sql(["v1"]))
def asof_join(spark, d):
    return _asof(spark, d, ["v1"]).select("k", "date", r("v1"))


@query("asof_multi_column", _asof_sql(["v1", "v2"]))
def asof_multi_column(spark, d):
    return _asof(spark, d, ["v1", "v2"]).select("k", "date", r("v1"), r("v2"))


@query("asof_lagged", _asof_sql(["v1"], 1, "_lag1"))
def asof_lagged(spark, d):
    return _asof(spark, d, ["v1"], lag_days=1, suffix="_lag1").select("k", "date", r("v1_lag1"))


@query("window_mean_join", f"SELECT s.k, s.date, round(m.v1, 6) AS v1 FROM series s LEFT JOIN (SELECT k, greatest(next_on_or_after, DATE '1995-06-01') AS date, avg(v1) AS v1 FROM signals JOIN daymap ON avail = daymap.date WHERE greatest(next_on_or_after, DATE '1995-06-01') <= {LAST} GROUP BY 1, 2) m ON s.k = m.k AND s.date = m.date WHERE s.date >= DATE '1995-06-01'")
def window_mean_join(spark, d):
    base = series(spark, d).select("k", "date").where("date >= '1995-06-01'")
    m = session_map(spark, d)
    return align.window_mean_join(base, signals(spark, d).select("k", "avail", "v1"), ["v1"], m, ["k"], F.lit("1995-06-01").cast("date"), F.lit(traded(spark, d)[1])).select("k", "date", r("v1"))


@query("publication_date", "SELECT o_orderkey AS id, ref, CASE WHEN ref >= DATE '1999-06-21' THEN ref ELSE f.next_after END AS release, s.next_after AS published FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ref FROM orders) o LEFT JOIN fedmap f ON f.date = ref LEFT JOIN daymap s ON s.date = CASE WHEN ref >= DATE '1999-06-21' THEN ref ELSE f.next_after END")
def publication_date(spark, d):
    refs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("ref"))
    return align.publication_date(refs, business_map(spark, d), session_map(spark, d), "ref", "1999-06-21").select("id", "ref", "release", "published")


CTE["filings"] = "SELECT event_id AS id, user_id % 10 AS entity, event_type AS form, CASE WHEN event_id % 13 <> 0 THEN epoch(ts) END AS at_s, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS filed FROM events"
CTE["filed_at"] = "SELECT f.*, available, CASE WHEN available = local THEN 'pre' ELSE 'post' END AS phase FROM (SELECT *, CAST(timezone('America/New_York', to_timestamp(at_or)) AS DATE) AS local, (SELECT min(session_date) FROM sessions24 WHERE close_s > at_or) AS available FROM (SELECT *, coalesce(at_s, epoch(timezone('America/New_York', CAST(filed AS TIMESTAMP) + INTERVAL '23:59' HOUR TO MINUTE))) AS at_or FROM filings)) f"
CTE["filed_at"] = CTE["filed_at"].replace("INTERVAL '23:59' HOUR TO MINUTE", "INTERVAL 1439 MINUTE").replace("SELECT f.*, available, CASE", "SELECT id, entity, form, filed, available, CASE")


def _filed(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("entity"), F.col("event_type").alias("form"), F.when(F.col("event_id") % 13 != 0, F.col("ts")).alias("accepted"), F.from_utc_timestamp("ts", "America/New_York").cast("date").alias("filed"))
    return align.first_close_after(e, session_map(spark, d, "spine24"))


@query("first_close_after", "SELECT id, entity, form, available, phase FROM filed_at")
def first_close_after(spark, d):
    return _filed(spark, d).select("id", "entity", "form", "available", "phase")


CTE["vint"] = "SELECT o_orderpriority AS k, date_trunc('month', o_orderdate) AS ref_month, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) + 10 + CAST(o_orderkey % 90 AS INT) AS rt, o_totalprice AS value, o_orderkey AS seq FROM orders"
CTE["vlast"] = "SELECT k, CAST(ref_month AS DATE) AS ref_month, rt, arg_max(value, seq) AS value FROM vint GROUP BY ALL"
CTE["vrel"] = "SELECT k, rt, max(m) OVER (PARTITION BY k ORDER BY rt) AS ref_month FROM (SELECT k, rt, CAST(max(ref_month) AS DATE) AS m FROM vint GROUP BY k, rt)"
CTE["vknown"] = "SELECT r.k, r.rt, r.ref_month, coalesce(r.ref_month > lag(r.ref_month) OVER (PARTITION BY r.k ORDER BY r.rt), true) AS is_new_print, a.value AS level, a.value / b.value - 1 AS yoy FROM vrel r ASOF LEFT JOIN vlast a ON a.k = r.k AND a.ref_month = r.ref_month AND r.rt >= a.rt ASOF LEFT JOIN vlast b ON b.k = r.k AND b.ref_month = CAST(r.ref_month - INTERVAL 12 MONTH AS DATE) AND r.rt >= b.rt"


def _vintages(spark, d):
    month = F.trunc("o_orderdate", "month")
    v = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), month.alias("ref_month"), F.date_add(F.add_months(month, 1), (10 + F.col("o_orderkey") % 90).cast("int")).alias("realtime_start"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))
    return align.vintage_as_known(v, ["k"])


@query("vintage_as_known", "SELECT k, rt AS realtime_start, ref_month, round(level, 6) AS level, round(yoy, 6) AS yoy FROM vknown")
def vintage_as_known(spark, d):
    return _vintages(spark, d).select("k", "realtime_start", "ref_month", r("level"), r("yoy"))


@query("is_new_print", "SELECT k, rt AS realtime_start, is_new_print FROM vknown")
def is_new_print(spark, d):
    return _vintages(spark, d).select("k", "realtime_start", "is_new_print")


@query("vintage_daily", "SELECT p.k, s.date, round(v.level, 6) AS level, round(v.yoy, 6) AS yoy FROM (SELECT DISTINCT o_orderpriority AS k FROM orders) p CROSS JOIN spine s ASOF LEFT JOIN vknown v ON v.k = p.k AND s.date >= v.rt")
def vintage_daily(spark, d):
    known = _vintages(spark, d).withColumnRenamed("realtime_start", "avail")
    grid = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k")).distinct().crossJoin(F.broadcast(days(spark, d).select("date")))  # a day each for every series
    # yoy of a release is known with its level, missing or not
    both = align.asof_join(grid, known.withColumn("v", F.struct("level", "yoy")), ["v"], ["k"], last=last_day(spark, d))
    return both.select("k", "date", r("v.level", "level"), r("v.yoy", "yoy"))


@query("membership_flags", "SELECT session_date AS date, CAST(session_date IN (SELECT date FROM evdays) AS INT) AS is_event_day, CAST(session_date IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '2-HIGH') AS INT) AS is_high_day FROM sessions")
def membership_flags(spark, d):
    s = sessions(spark, d).select(F.col("session_date").alias("date"))
    o = table(spark, d, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    for name, rows in (("is_event_day", o.where("o_orderpriority = '1-URGENT' and o_orderkey % 11 = 0")), ("is_high_day", o.where("o_orderpriority = '2-HIGH'"))):
        s = s.join(rows.select("date").distinct().withColumn(name, F.lit(1)), "date", "left")
    return s.fillna(0)


@query("session_gap_report", f"SELECT k, date, 'missing' AS kind FROM (SELECT k, session_date AS date FROM (SELECT DISTINCT k FROM bars), sessions WHERE session_date BETWEEN {FIRST} AND {LAST} EXCEPT SELECT k, date FROM bars) UNION ALL SELECT k, date, 'extra' FROM bars WHERE date NOT IN (SELECT session_date FROM sessions)")
def session_gap_report(spark, d):
    b = bars(spark, d).select("k", "date")
    s = sessions(spark, d).select(F.col("session_date").alias("date")).where(F.col("date").between(*map(F.lit, traded(spark, d))))
    missing = b.select("k").distinct().crossJoin(F.broadcast(s)).join(b, ["k", "date"], "left_anti")
    extra = b.join(F.broadcast(sessions(spark, d).select(F.col("session_date").alias("date"))), "date", "left_anti")
    return missing.withColumn("kind", F.lit("missing")).unionByName(extra.withColumn("kind", F.lit("extra")))


CTE["old"] = "SELECT event_type AS k, CAST(ts AS DATE) AS date, count(*) AS n, sum(value) AS v FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2"
CTE["new"] = "SELECT event_type AS k, CAST(ts AS DATE) AS date, CASE WHEN count(*) % 2 = 0 THEN count(*) END AS n, sum(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2"


def _caches(spark, d):
    e = table(spark, d, "events").withColumn("date", F.col("ts").cast("date")).withColumnRenamed("event_type", "k")
    old = e.where("event_id % 3 <> 0").groupBy("k", "date").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    new = e.where("ts >= '2024-01-10'").groupBy("k", "date").agg(F.when(F.count("*") % 2 == 0, F.count("*")).alias("n"), F.sum("value").alias("v"))
    return old, new


@query("merge_cache", "SELECT coalesce(o.k, w.k) AS k, coalesce(o.date, w.date) AS date, coalesce(w.n, o.n) AS n, round(coalesce(w.v, o.v), 6) AS v FROM old o FULL JOIN new w ON o.k = w.k AND o.date = w.date")
def merge_cache(spark, d):
    return align.merge_cache(*_caches(spark, d), ["k", "date"], ["n", "v"]).select("k", "date", "n", r("v"))


@query("incremental_tail", "SELECT coalesce(o.k, w.k) AS k, coalesce(o.date, w.date) AS date, coalesce(w.n, o.n) AS n, round(coalesce(w.v, o.v), 6) AS v FROM (SELECT * FROM old WHERE date < DATE '2024-01-20') o FULL JOIN (SELECT w.* FROM new w JOIN (SELECT k, max(date) - 3 AS lo FROM old WHERE date < DATE '2024-01-20' AND n > 0 GROUP BY k) t ON w.k = t.k AND w.date >= t.lo) w ON o.k = w.k AND o.date = w.date")
def incremental_tail(spark, d):
    old, new = _caches(spark, d)
    old = old.where("date < '2024-01-20'")
    tail = landed.tail_of(old, new, ["k"], "n", overlap=3)
    return align.merge_cache(old, tail, ["k", "date"], ["n", "v"]).select("k", "date", "n", r("v"))


# windows ---------------------------------------------------------------------------------------------------------------

_W = "WINDOW w AS (PARTITION BY k ORDER BY date)"


@query("returns", f"SELECT k, date, round(close / lag(close) OVER w - 1, 6) AS return_1d, round(close / lag(close, 5) OVER w - 1, 6) AS return_5d, round(ln(close / lag(close) OVER w), 6) AS log_return_1d, round(volume / lag(volume) OVER w - 1, 6) AS volume_change_1d FROM series {_W}")
def returns(spark, d):
    w = by("k")
    return series(spark, d).select("k", "date", r(pct_change("close", w), "return_1d"), r(pct_change("close", w, 5), "return_5d"), r(log_return("close", w), "log_return_1d"), r(pct_change("volume", w), "volume_change_1d"))


def _roll(fn, c, n, least=None):
    frame = f"OVER (PARTITION BY k ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {frame} >= {least or n} THEN {fn}({c}) {frame} END"


@query("rolling_vol", f"SELECT k, date, round({_roll('stddev_samp', 'y', 20)}, 6) AS volatility_20d FROM rets")
def rolling_vol(spark, d):
    return rets(spark, d).select("k", "date", r(over(F.stddev_samp, "y", by("k"), 20), "volatility_20d"))


@query("rolling_min_periods", f"SELECT k, date, round({_roll('avg', 'v1', 22, 15)}, 4) AS m22, round({_roll('stddev_samp', 'v1', 20, 15)}, 4) AS s20, round({_roll('avg', 'v1', 7, 4)}, 4) AS m7 FROM (SELECT k, date, max(v1) AS v1 FROM (SELECT k, ref_date AS date, v1 FROM signals) GROUP BY k, date)")
def rolling_min_periods(spark, d):
    w = by("k")
    s = signals(spark, d).groupBy("k", F.col("ref_date").alias("date")).agg(F.max("v1").alias("v1"))
    return s.select("k", "date", r(over(F.avg, "v1", w, 22, 15), "m22", 4), r(over(F.stddev_samp, "v1", w, 20, 15), "s20", 4), r(over(F.avg, "v1", w, 7, 4), "m7", 4))


CTE["feats"] = f"""SELECT k, date, open, high, low, close, volume, y, idx, ln(open / lag(close) OVER w) AS overnight_gap, ({_roll('avg', 'hl', 22, 15)}) AS range_vol, ln(close / lag(close, 21) OVER w) AS momentum_21, ln(close / lag(close, 63) OVER w) AS momentum_63,
 ln(close / ({_roll('avg', 'close', 50, 40)})) AS dist_ma50, ln(close / ({_roll('avg', 'close', 200, 150)})) AS dist_ma200, (lv - {_roll('avg', 'lv', 20, 15)}) / nullif({_roll('stddev_samp', 'lv', 20, 15)}, 0) AS volume_z FROM (SELECT *, sqrt(ln(high / low) ** 2 / (4 * ln(2))) AS hl, ln(nullif(volume, 0)) AS lv FROM rets) {_W}"""
_FEATS = ["overnight_gap", "range_vol", "momentum_21", "momentum_63", "dist_ma50", "dist_ma200", "volume_z"]


def features(spark, d):
    return rets(spark, d).withColumns(rolling.price_features(by("k")))


@query("price_features", f"SELECT k, date, {', '.join(f'round({c}, 6) AS {c}' for c in _FEATS)} FROM feats")
def price_features(spark, d):
    return features(spark, d).select("k", "date", *map(r, _FEATS))


@query("diff_features", f"SELECT k, date, round(v1 - lag(v1) OVER w, 4) AS diff, round(100 * (v1 - lag(v1) OVER w), 4) AS diff_bp, round(ln(v1) - ln(lag(v1) OVER w), 6) AS log_diff FROM ({_asof_sql(['v1'])}) {_W}")
def diff_features(spark, d):
    w = by("k")
    v, before = F.col("v1"), F.lag("v1").over(w)
    return _asof(spark, d, ["v1"]).withColumn("v1", F.round("v1", 6)).select("k", "date", r(v - before, "diff", 4), r(100 * (v - before), "diff_bp", 4), r(F.ln(v) - F.ln(before), "log_diff"))


CTE["sparse"] = "SELECT k, ref_date AS date, max(v1) AS v1, max(CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END) AS flag FROM signals GROUP BY k, ref_date"


def _sparse(spark, d):
    return signals(spark, d).groupBy("k", F.col("ref_date").alias("date")).agg(F.max("v1").alias("v1"), F.max(F.when(F.col("id") % 9 == 0, 1).otherwise(0)).alias("flag"))


@query("ffill", f"SELECT k, date, round(last_value(v1 IGNORE NULLS) OVER w, 6) AS v1 FROM sparse {_W}")
def forward_filled(spark, d):
    return _sparse(spark, d).select("k", "date", r(ffill("v1", by("k")), "v1"))


@query("days_since_flag", f"SELECT k, date, CAST(date - last_value(CASE WHEN flag = 1 THEN date END IGNORE NULLS) OVER w AS INT) AS days_since FROM sparse {_W}")
def days_since_flag(spark, d):
    return _sparse(spark, d).select("k", "date", F.datediff("date", ffill(F.when(F.col("flag") == 1, F.col("date")), by("k"))).alias("days_since"))


@query("ewm_halflife", "SELECT a.k, a.date, round(sum(b.v1 * power(0.5, (a.i - b.i) / 3.0)) / sum(power(0.5, (a.i - b.i) / 3.0)), 4) AS ewm FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) AS i FROM sparse) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) AS i FROM sparse) b ON a.k = b.k AND b.i BETWEEN a.i - 158 AND a.i AND b.v1 IS NOT NULL GROUP BY a.k, a.date")
def ewm_halflife(spark, d):
    return _sparse(spark, d).select("k", "date", r(rolling.ewm("v1", by("k"), 3), "ewm", 4))


@query("max_gap", f"SELECT k, CAST(max(gap) AS INT) AS max_gap FROM (SELECT k, date - lag(date) OVER w AS gap FROM bars {_W}) GROUP BY k")
def max_gap(spark, d):
    return bars(spark, d).withColumn("gap", F.datediff("date", F.lag("date").over(by("k")))).groupBy("k").agg(F.max("gap").alias("max_gap"))


@query("trailing_sigma", f"SELECT k, date, round(stddev_samp(y) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 6) AS sigma FROM rets")
def trailing_sigma(spark, d):
    return rets(spark, d).select("k", "date", r(F.stddev_samp("y").over(by("k").rowsBetween(-59, 0)), "sigma"))


# feature table ---------------------------------------------------------------------------------------------------------

#: Column, group, role of the feature table.
ROLES = [
    ("y", "target", "target"), ("close", "price", "raw"), ("volume", "price", "raw"),
    *((c, "price", "past") for c in _FEATS), ("v1_lag1", "signal", "past"), ("v1_diff", "signal", "past"), ("v2_lag1", "signal", "past"), ("news_mean", "news", "past"), ("vol_ratio", "price", "past"),
    *((c, "calendar", "known_future") for c in ("days_to_event", "is_event_day", "is_event_day_before", "is_month_end", "is_opex_day", "is_opex_week", "day_of_week", "is_pre_holiday")),
]
_WARM = 200
_COLUMNS = [c for c, _, _ in ROLES]
_CAL = [c for c, g, _ in ROLES if g == "calendar"]
CTE["table0"] = f"""SELECT f.*, j1.v1 AS v1_lag1, j2.v2 AS v2_lag1, n.news_mean, {', '.join('cal.' + c for c in _CAL)} FROM feats f
 ASOF LEFT JOIN (SELECT k, avail + 1 AS a, last(v1 ORDER BY ref_date, id) AS v1 FROM signals WHERE v1 IS NOT NULL GROUP BY 1, 2) j1 ON f.k = j1.k AND f.date >= j1.a
 ASOF LEFT JOIN (SELECT k, avail + 1 AS a, last(v2 ORDER BY ref_date, id) AS v2 FROM signals WHERE v2 IS NOT NULL GROUP BY 1, 2) j2 ON f.k = j2.k AND f.date >= j2.a
 LEFT JOIN (SELECT k, greatest(next_on_or_after, {FIRST}) AS date, avg(v1) AS news_mean FROM signals JOIN daymap ON avail = daymap.date WHERE greatest(next_on_or_after, {FIRST}) <= {LAST} GROUP BY 1, 2) n ON f.k = n.k AND f.date = n.date
 LEFT JOIN (SELECT * FROM cal WHERE date BETWEEN {FIRST} AND {LAST}) cal ON cal.date = f.date"""
CTE["ftable"] = f"SELECT *, v1_lag1 - lag(v1_lag1) OVER (PARTITION BY k ORDER BY date) AS v1_diff, range_vol / nullif(({_roll('avg', 'range_vol', 50, 40)}), 0) AS vol_ratio FROM table0"


def feature_frame(spark, d):
    """All features of every series and session, before the warm-up is cut. Two as-of columns share one shuffle."""
    base = features(spark, d)
    base = align.asof_join(base, signals(spark, d), ["v1", "v2"], ["k"], ties=["ref_date", "id"], lag_days=1, suffix="_lag1", last=last_day(spark, d))
    news = signals(spark, d).select("k", "avail", F.col("v1").alias("news_mean"))
    base = align.window_mean_join(base, news, ["news_mean"], session_map(spark, d), ["k"], *map(F.lit, traded(spark, d)))
    base = base.join(F.broadcast(_calendar(spark, d).select("date", *_CAL)), "date", "left")
    w = by("k")
    return base.withColumn("v1_diff", F.col("v1_lag1") - F.lag("v1_lag1").over(w)).withColumn("vol_ratio", ratio(F.col("range_vol"), over(F.avg, "range_vol", w, 50, 40)))


def _rounded_sql(columns):
    whole = set(_CAL)
    return ", ".join(c if c in whole else f"round({c}, {6 if c == 'close' else 4}) AS {c}" for c in columns)


@query("feature_table", f"SELECT k, date, {_rounded_sql(_COLUMNS)} FROM ftable WHERE y IS NOT NULL AND idx > {_WARM}")
def feature_table(spark, d):
    out = feature_frame(spark, d).where(f"y is not null and idx > {_WARM}")
    return out.select("k", "date", *(F.col(c) if c in _CAL else r(c, places=6 if c == "close" else 4) for c in _COLUMNS))


@query("feature_roles", f"SELECT c AS \"column\", g AS \"group\", r AS role, n AS n_values FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, {chr(39)}{g}{chr(39)}, {chr(39)}{x}{chr(39)})' for c, g, x in ROLES)}) t(c, g, r) JOIN (UNPIVOT (SELECT {', '.join(f'count({c}) AS {c}' for c in _COLUMNS)} FROM ftable) ON {', '.join(_COLUMNS)} INTO NAME c VALUE n) USING (c)")
def feature_roles(spark, d):
    counts = feature_frame(spark, d).agg(*(F.count(c).alias(c) for c in _COLUMNS))
    roles = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(g).alias("group"), F.lit(x).alias("role"), F.col(c).alias("n_values")) for c, g, x in ROLES)))
    return counts.select(roles.alias("x")).select("x.*")


def select_columns(profile: str = "full", only: list[str] | None = None, groups: list[str] | None = None, without: list[str] = ()) -> list[str]:
    """Covariates of a profile (target: none; core: price and calendar; full: all), then of groups, less exclusions; unknown, repeated and non-covariate names raise."""
    role = {c: (g, x) for c, g, x in ROLES}
    chosen = list(only) if only is not None else [c for c, (g, x) in role.items() if x in ("past", "known_future") and (profile == "full" or profile == "core" and g in ("price", "calendar"))]
    if len(set(chosen)) != len(chosen) or any(c not in role or role[c][1] not in ("past", "known_future") for c in [*chosen, *without]):
        raise ValueError(f"not covariates, or repeated: {chosen}, {list(without)}")
    return [c for c in chosen if (groups is None or role[c][0] in groups) and c not in without]


_CHOSEN = select_columns("core", groups=["price"], without=["volume_z"])


@query("select_features", f"SELECT k, date, {_rounded_sql(['y', *_CHOSEN])} FROM ftable WHERE y IS NOT NULL")
def select_features(spark, d):
    return feature_frame(spark, d).where("y is not null").select("k", "date", *(r(c, places=4) for c in ["y", *_CHOSEN]))
