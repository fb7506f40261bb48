"""Rules by period, recomputed rates, readiness, statement links and the contract of runs."""

from __future__ import annotations

from datetime import UTC, date, datetime, time
from functools import reduce

from pyspark.sql import functions as F

from tidemark.operators import calendar, contract, rules, text
from tidemark.operators.rolling import by, ffill
from tidemark.plans import features as plan
from tidemark.plans.base import CTE, business_map, last_day, query, r, series, session_map, sessions, table, traded
from tidemark.plans.evaluation import CELL, HORIZON, scored, targets

# rules -----------------------------------------------------------------------------------------------------------------

_D = date.fromisoformat
RULES = [
    ("volume score centred", "volume_z_20d", "mean", None, None, -0.1, 0.1, "FAIL"),
    ("volume score scale", "volume_z_20d", "std", None, None, 0.7, 1.3, "FAIL"),
    ("return scale", "log_return_1d", "std", None, None, 0.5, 3.0, "FAIL"),
    ("range volatility not negative", "parkinson_vol_1d", "min", None, None, 0.0, 100.0, "FAIL"),
    ("term ratio in 1997", "vix_term_ratio", "median", _D("1997-01-01"), _D("1997-12-31"), 0.9, 1.1, "FAIL"),
    ("own return less the index", "qqq_minus_spy", "mean", None, None, -0.05, 0.05, "FAIL"),
    ("two-year rate in basis points", "d_dgs2_bp", "std", None, None, 2.0, 12.0, "FAIL"),
    ("curve inverted", "t10y2y_lag1", "negative_share", _D("1996-08-01"), _D("1998-06-30"), 0.95, 1.0, "FAIL"),
    ("price index peak", "cpi_yoy", "year_of_max", None, None, 1996.0, 1998.0, "WARN"),
    ("deflation in 1996", "cpi_yoy", "min", _D("1996-01-01"), _D("1996-12-31"), -1.0, -0.01, "FAIL"),
    ("no news before the start", "gdelt_ai_news_share", "present_share", None, _D("1995-12-31"), 0.0, 0.0, "FAIL"),
    ("news since the start", "gdelt_ai_news_share", "present_share", _D("1996-01-01"), None, 0.95, 1.0, "FAIL"),
    ("statement days a year", "is_fomc_day", "sum_a_year", _D("1996-01-01"), _D("2000-12-31"), 7.5, 60.0, "FAIL"),
    ("worst day", "log_return_1d", "year_of_min", None, None, 1995.0, 2001.0, "WARN"),
    ("largest range", "parkinson_vol_22d", "max", None, None, 0.1, 5.0, "WARN"),
]
_RULED = sorted({c for _, c, *_ in RULES})
_STAT = {
    "mean": "avg(v)", "std": "stddev_samp(v)", "median": "quantile_cont(v, 0.5)", "min": "min(v)", "max": "max(v)", "negative_share": "avg(CAST(v < 0 AS INT))", "present_share": "count(v) / count(*)",
    "year_of_max": "(list(year(date) ORDER BY round(v, 9) DESC, date) FILTER (v IS NOT NULL))[1]", "year_of_min": "(list(year(date) ORDER BY round(v, 9), date) FILTER (v IS NOT NULL))[1]", "sum_a_year": "sum(v) / count(DISTINCT year(date))",
}
CTE["ruled"] = " UNION ALL ".join(f"SELECT k, date, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM daily WHERE {plan._CUT}" for c in _RULED)


def _rule_sql(rule):
    name, column, stat, lo, hi, low, high, miss = rule
    period = (f" AND date >= DATE '{lo}'" if lo else "") + (f" AND date <= DATE '{hi}'" if hi else "")
    return f"SELECT k, '{name}' AS rule, count(v) AS n, {_STAT[stat]} AS value, CASE WHEN {_STAT[stat]} BETWEEN {low} AND {high} THEN 'PASS' ELSE '{miss}' END AS status FROM ruled WHERE col = '{column}'{period} GROUP BY k"


@query("period_rules", "SELECT k, rule, n, round(value, 4) AS value, status FROM (" + " UNION ALL ".join(map(_rule_sql, RULES)) + ")")
def period_rules(spark, d):
    df = plan.daily(spark, d).where(plan._CUT).select("k", "date", *_RULED)
    return rules.judged(df, rules.table(spark, RULES), ["k"]).select("k", "rule", "n", r("value", places=4), "status")


CTE["rate_at"] = "SELECT s.next_after AS date, last(o.dgs2 ORDER BY o.date) AS x FROM s_rates o JOIN fedmap f ON f.date = o.date JOIN daymap s ON s.date = f.next_after WHERE o.dgs2 IS NOT NULL GROUP BY 1"


@query("rate_recompute", f"SELECT k, count(g) AS n, round(max(g), 6) AS gap FROM (SELECT k, idx, y, abs(d - d_dgs2_bp) AS g FROM (SELECT b.k, b.date, 100 * (v - lag(v) OVER (PARTITION BY b.k ORDER BY b.date)) AS d FROM (SELECT k, date FROM series) b JOIN (SELECT session_date AS date, last_value(x IGNORE NULLS) OVER (ORDER BY session_date) AS v FROM sessions LEFT JOIN rate_at ON rate_at.date = session_date) q ON q.date = b.date) JOIN (SELECT k, date, idx, log_return_1d AS y, d_dgs2_bp FROM daily) USING (k, date)) GROUP BY k")
def rate_recompute(spark, d):
    """The change of a rate in the table against one made again: by session maps and a fill forward over the sessions, without an as-of join."""
    release = F.broadcast(business_map(spark, d).select("date", F.col("next_after").alias("release")))
    known = plan.rates(spark, d).where("dgs2 is not null").join(release, "date").join(F.broadcast(session_map(spark, d).select(F.col("date").alias("release"), F.col("next_after").alias("day"))), "release")
    at = known.groupBy(F.col("day").alias("date")).agg(F.max_by("dgs2", "date").alias("x"))
    filled = sessions(spark, d).select(F.col("session_date").alias("date"), F.lit("all").alias("c")).join(at, "date", "left").select("date", ffill("x", by("c")).alias("v"))  # a row a session
    again = series(spark, d).select("k", "date").join(F.broadcast(filled), "date").select("k", "date", (100 * (F.col("v") - F.lag("v").over(by("k")))).alias("d"))
    both = again.join(plan.daily(spark, d).select("k", "date", "d_dgs2_bp"), ["k", "date"]).withColumn("g", F.abs(F.col("d") - F.col("d_dgs2_bp")))
    return both.groupBy("k").agg(F.count("g").alias("n"), r(F.max("g"), "gap"))


# readiness -------------------------------------------------------------------------------------------------------------

#: Of each source a column that tells how fresh it is, and its lag.
FRESH = {"vol": ("vxn_close", 1), "cross": ("spy_log_ret", 0), "fred": ("dgs2", 1), "epu": ("epu_daily", 1), "gdelt": ("ai_avg_tone", 1), "sec": ("sec_total_filings", 0), "tone": ("fomc_net_hawkish_last", 0)}
KNOWN = ("is_event_day", "days_to_event", "day_of_week", "is_opex_week")


def conditions(spark, d, as_of: datetime, horizon: int = HORIZON):
    """condition, subject, observed, expected, ok: that each series ends with the last session completed at the instant, that each
    source is fresh at the table's end, and that the calendar covers the next sessions without a gap. Any row that isn't ok closes the gate."""
    at = F.lit(as_of)
    ends = series(spark, d).groupBy("k").agg(F.max("date").alias("observed"))
    done = sessions(spark, d).where(F.col("close_ts") <= at).agg(F.max("session_date").alias("expected"))  # one row each, as the next
    cutoff = ends.agg(F.max("observed").alias("cutoff"))
    rows = [ends.crossJoin(F.broadcast(done)).select(F.lit("table_end").alias("condition"), F.col("k").alias("subject"), "observed", "expected", F.col("observed").eqNullSafe(F.col("expected")).alias("ok"))]
    for name, (column, lag) in FRESH.items():
        last = plan.SOURCES[name](spark, d).where(F.col(column).isNotNull()).select("date").crossJoin(F.broadcast(cutoff)).where("date <= cutoff").agg(F.max("date").alias("observed"))
        due = last.crossJoin(F.broadcast(cutoff)).withColumn("expected", F.date_sub("cutoff", max(4, lag + 3)))
        rows.append(due.select(F.lit("fresh").alias("condition"), F.lit(name).alias("subject"), "observed", "expected", F.coalesce(F.col("observed") >= F.col("expected"), F.lit(False)).alias("ok")))
    events = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderkey % 11 = 0").select(F.col("o_orderdate").cast("date").alias("date"))
    known = calendar.event_calendar(sessions(spark, d), events, traded(spark, d)[0], last_day(spark, d))
    ahead = known.crossJoin(F.broadcast(cutoff)).where("date > cutoff").withColumn("step", F.row_number().over(by("cutoff"))).where(F.col("step") <= horizon)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in KNOWN])
    cover = ahead.agg(F.max(F.when(whole, F.col("date"))).alias("observed"), F.max("date").alias("expected"), F.count_if(whole).alias("n"))
    rows.append(cover.select(F.lit("horizon").alias("condition"), F.lit("calendar").alias("subject"), "observed", "expected", (F.col("n") == horizon).alias("ok")))
    return reduce(lambda a, b: a.unionByName(b), rows)


def _fresh_sql(name):
    column, lag = FRESH[name]
    return f"SELECT 'fresh' AS condition, '{name}' AS subject, max(date) AS observed, (SELECT hi FROM ended) - {max(4, lag + 3)} AS expected, coalesce(max(date) >= (SELECT hi FROM ended) - {max(4, lag + 3)}, false) AS ok FROM {plan._SQL[name]} WHERE {column} IS NOT NULL AND date <= (SELECT hi FROM ended)"


CTE["ended"] = "SELECT max(date) AS hi FROM series"
CTE["ahead"] = f"SELECT * FROM cal WHERE date > (SELECT hi FROM ended) ORDER BY date LIMIT {HORIZON}"
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in KNOWN)
_LAST = "(SELECT max(session_date) FROM sessions WHERE close_s <= epoch(CAST((SELECT hi FROM span) AS TIMESTAMP)) + 82800)"


@query("readiness_conditions", f"SELECT 'table_end' AS condition, k AS subject, max(date) AS observed, {_LAST} AS expected, max(date) IS NOT DISTINCT FROM {_LAST} AS ok FROM series GROUP BY k UNION ALL " + " UNION ALL ".join(map(_fresh_sql, FRESH)) + f" UNION ALL SELECT 'horizon', 'calendar', max(date) FILTER ({_WHOLE}), max(date), count(*) FILTER ({_WHOLE}) = {HORIZON} FROM ahead")
def readiness_conditions(spark, d):
    """As of eleven in the evening (UTC) of the last traded day."""
    return conditions(spark, d, datetime.combine(traded(spark, d)[1], time(23), UTC))


# statements ------------------------------------------------------------------------------------------------------------


def _pages(spark, d):
    """A page for each order: a link to a statement of its date in one of two addresses, a like address or another text, and a link that is none."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    address = F.when(key % 5 == 1, F.concat(F.lit("/newsevents/press/monetary/"), day, F.lit("b.htm"))).when(key % 5 == 2, F.concat(F.lit("/pressmonetary"), day, F.lit("a.htm"))).when(key % 5 == 3, F.concat(F.lit("/newsevents/pressreleases/monetary/"), day, F.lit("a.htm"))).otherwise(F.concat(F.lit("/newsevents/pressreleases/monetary"), day, F.lit("a.htm")))
    label = F.when(key % 5 == 4, "Minutes").when(key % 2 == 0, " Statement ").otherwise("HTML")
    return o.select(key.alias("page_id"), F.concat(F.lit('<p><a href="/news.htm">Statement</a> <a href="'), address, F.lit('">'), label, F.lit("</a></p>")).alias("html"))


@query("statement_links", "SELECT date, page_id, CASE WHEN page_id % 5 = 1 THEN '/newsevents/press/monetary/' || strftime(date, '%Y%m%d') || 'b.htm' ELSE '/newsevents/pressreleases/monetary' || strftime(date, '%Y%m%d') || 'a.htm' END AS href FROM (SELECT CAST(o_orderdate AS DATE) AS date, min(o_orderkey) AS page_id FROM orders WHERE o_orderkey % 5 IN (0, 1) GROUP BY 1)")
def statement_links(spark, d):
    return text.first_per_date(_pages(spark, d).select("page_id", F.posexplode(text.statement_links(F.col("html"), ["Statement", "HTML"])).alias("pos", "x")).select("page_id", "pos", "x.*"), ["page_id", "pos"]).select("date", "page_id", "href")


# contract --------------------------------------------------------------------------------------------------------------


def landed_runs(spark, d):
    """Rows, saved metrics and metadata of the runs as a landing with faults would have them: each fault is at one place of its own."""
    s = scored(spark, d)
    is_ = lambda **at: reduce(lambda a, b: a & b, [F.col(c) == v for c, v in at.items()])
    copies = F.when(is_(rung=60, seed=1, model="tuned", window=1), 0).when(is_(rung=20, seed=2, window=0, horizon=1), 2).otherwise(1)
    rows = s.select(*CELL, "model", "k", "window", "horizon", "actual", "prediction", "pinball").withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).drop("copy")
    rows = rows.withColumns({
        "prediction": F.when(is_(rung=20, fold=1999, seed=0, model="base", window=3), float("nan")).otherwise(F.col("prediction")),
        "actual": F.when(is_(rung=120, fold=1997, seed=0, model="tuned", window=2, horizon=3), F.col("actual") + 0.5).otherwise(F.col("actual")),
    })
    good = s.groupBy(*CELL, "model").agg((2 * F.sum("pinball") / F.sum(F.abs("actual"))).alias("wql"))
    times = F.when(is_(rung=20, fold=1997, seed=0, model="base"), 0).when(is_(rung=20, fold=1997, seed=1, model="tuned"), 2).otherwise(1)
    saved = good.withColumn("horizon", F.lit("overall")).withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).drop("copy").withColumn("wql", F.when(is_(rung=120, fold=1998), F.col("wql") + 0.01).otherwise(F.col("wql")))
    told = good.select(*CELL).distinct().where(~is_(rung=120, fold=1999, seed=1)).withColumn("told_seed", F.when(is_(rung=60, fold=1999, seed=2), 7).otherwise(F.col("seed")))
    return rows, saved, told


CTE["landed_rows"] = "SELECT rung, fold, seed, model, k, window_id, horizon, CASE WHEN rung = 120 AND fold = 1997 AND seed = 0 AND model = 'tuned' AND window_id = 2 AND horizon = 3 THEN actual + 0.5 ELSE actual END AS actual, CASE WHEN rung = 20 AND fold = 1999 AND seed = 0 AND model = 'base' AND window_id = 3 THEN 'nan'::DOUBLE ELSE prediction END AS prediction, pinball FROM (SELECT *, unnest(range(0, CASE WHEN rung = 60 AND seed = 1 AND model = 'tuned' AND window_id = 1 THEN 0 WHEN rung = 20 AND seed = 2 AND window_id = 0 AND horizon = 1 THEN 2 ELSE 1 END)) FROM scored)"
CTE["landed_saved"] = "SELECT rung, fold, seed, model, CASE WHEN rung = 120 AND fold = 1998 THEN wql + 0.01 ELSE wql END AS wql FROM (SELECT *, unnest(range(0, CASE WHEN rung = 20 AND fold = 1997 AND seed = 0 AND model = 'base' THEN 0 WHEN rung = 20 AND fold = 1997 AND seed = 1 AND model = 'tuned' THEN 2 ELSE 1 END)) FROM (SELECT rung, fold, seed, model, 2 * sum(pinball) / sum(abs(actual)) AS wql FROM scored GROUP BY ALL))"
CTE["per_key"] = "SELECT rung, fold, seed, model, k, window_id, horizon, count(*) AS copies, min(actual) AS lo, max(actual) AS hi, sum(pinball) AS loss, sum(abs(actual)) AS scale, count(*) FILTER (NOT isfinite(prediction) OR NOT isfinite(actual)) AS odd FROM landed_rows GROUP BY ALL"
CTE["per_run"] = "SELECT o.*, e.n_expected, x.n_overall, x.hi AS reported_hi, x.lo AS reported_lo, 2 * loss / scale AS wql FROM (SELECT rung, fold, seed, model, count(*) FILTER (copies > 1) AS repeated, sum(copies) AS n_rows, sum(loss) AS loss, sum(scale) AS scale, sum(odd) AS odd FROM per_key GROUP BY rung, fold, seed, model) o LEFT JOIN (SELECT rung, fold, seed, model, count(*) AS n_overall, max(wql) AS hi, min(wql) AS lo FROM landed_saved GROUP BY ALL) x USING (rung, fold, seed, model) LEFT JOIN (SELECT fold, count(*) AS n_expected FROM tgt GROUP BY fold) e USING (fold)"
CTE["per_cell"] = "SELECT rung, fold, seed, count(*) FILTER (sides <> 2) AS unpaired, count(*) FILTER (hi - lo > 1e-9) AS differs FROM (SELECT rung, fold, seed, k, window_id, horizon, count(*) AS sides, min(lo) AS lo, max(hi) AS hi FROM per_key GROUP BY ALL) GROUP BY rung, fold, seed"
_OWN = {"repeated_key": "repeated", "not_finite": "odd", "wrong_row_count": "CASE WHEN n_rows IS DISTINCT FROM n_expected THEN abs(n_rows - coalesce(n_expected, 0)) ELSE 0 END", "no_overall_row": "CAST(n_overall IS NULL AS INT)", "several_overall_rows": "CASE WHEN n_overall > 1 THEN n_overall ELSE 0 END", "metric_differs": "CAST(coalesce(greatest(abs(reported_hi - wql), abs(reported_lo - wql)) > 1e-9, false) AS INT)"}
_CELLS = {"unpaired_key": "unpaired", "label_differs": "differs", "seed_differs": "CAST(rung = 60 AND fold = 1999 AND seed = 2 AS INT)", "no_metadata": "CAST(rung = 120 AND fold = 1999 AND seed = 1 AS INT)"}


@query("contract_audit", "SELECT rung, fold, seed, model, kind, CAST(n AS BIGINT) AS n FROM (" + " UNION ALL ".join([f"SELECT rung, fold, seed, model, '{k}' AS kind, {e} AS n FROM per_run" for k, e in _OWN.items()] + [f"SELECT rung, fold, seed, NULL, '{k}', {e} FROM per_cell" for k, e in _CELLS.items()]) + ") WHERE n > 0")
def contract_audit(spark, d):
    rows, saved, told = landed_runs(spark, d)
    expected = targets(spark, d).groupBy("fold").agg(F.count("*").alias("n_expected"))
    return contract.violations(rows, saved, told, CELL, ["k", "window", "horizon"], ("base", "tuned"), expected)
