"""The full daily feature table from its declared list: sources made of the given tables, their inputs and rules, features and roles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import ratio
from tidemark.operators import align, features, rolling
from tidemark.operators.features import ASOF, MEAN, PUBLISHED, SESSION, SPREAD, Feature, Input
from tidemark.operators.rolling import by, log_return, pct_change
from tidemark.operators.rolling import rolling as over
from tidemark.plans.base import CTE, business_map, last_day, query, r, series, session_map, sessions, table, traded
from tidemark.plans.market import _WARM, _calendar, _roll, _vintages

#: Names of the sources' columns and of the table's.
TICKERS = ("tlt", "hyg", "spy", "iwm", "smh", "gld", "oil", "dxy")
RATES = ("dff", "dgs10", "dgs2", "dfii10", "t10y2y", "t5yie")
TOPICS = ("ai", "semiconductor", "fed", "inflation", "big_tech_earnings", "recession")
CUTOVER = "1999-06-21"

# sources ---------------------------------------------------------------------------------------------------------------


def _orders(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("stamp"))


def volatility(spark, d):
    """Daily levels of five indices, a spread and two ratios."""
    level = lambda p: F.avg(F.when(F.col("p") == p, F.col("v")))
    o = _orders(spark, d).groupBy("date").agg(level("1-URGENT").alias("vxn_close"), level("2-HIGH").alias("vix_close"), level("3-MEDIUM").alias("vix3m"), level("4-NOT SPECIFIED").alias("vix9d"), level("5-LOW").alias("vvix"))
    vix = F.col("vix_close")
    return o.withColumns({"vxn_minus_vix": F.col("vxn_close") - vix, "vix_term_ratio": ratio(vix, F.col("vix3m")), "vix9d_ratio": ratio(F.col("vix9d"), vix)})


CTE["fo"] = "SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS id, o_custkey AS c, o_orderpriority AS p, o_totalprice AS v, o_orderdate AS stamp FROM orders"
CTE["s_vol"] = "SELECT *, vxn_close - vix_close AS vxn_minus_vix, vix_close / vix3m AS vix_term_ratio, vix9d / vix_close AS vix9d_ratio FROM (SELECT date, avg(v) FILTER (p = '1-URGENT') AS vxn_close, avg(v) FILTER (p = '2-HIGH') AS vix_close, avg(v) FILTER (p = '3-MEDIUM') AS vix3m, avg(v) FILTER (p = '4-NOT SPECIFIED') AS vix9d, avg(v) FILTER (p = '5-LOW') AS vvix FROM fo GROUP BY date)"


def cross_asset(spark, d):
    """Log returns of each ticker between its own days, one column a ticker."""
    t = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 8).cast("int").alias("k"), F.col("l_shipdate").cast("date").alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
    y = t.withColumn("y", log_return("close", by("k")))
    return y.groupBy("date").pivot("k", list(range(8))).agg(F.first("y")).select("date", *(F.col(str(i)).alias(f"{n}_log_ret") for i, n in enumerate(TICKERS)))


CTE["s_cross"] = "SELECT date, " + ", ".join(f"max(y) FILTER (k = {i}) AS {n}_log_ret" for i, n in enumerate(TICKERS)) + " FROM (SELECT k, date, ln(close / lag(close) OVER (PARTITION BY k ORDER BY date)) AS y FROM (SELECT l_suppkey % 8 AS k, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2)) GROUP BY date"


def rates(spark, d):
    return _orders(spark, d).groupBy("date").agg(*(F.avg(F.when(F.col("c") % 6 == i, F.col("v") / 99991)).alias(n) for i, n in enumerate(RATES)))


CTE["s_rates"] = "SELECT date, " + ", ".join(f"avg(v / 99991) FILTER (c % 6 = {i}) AS {n}" for i, n in enumerate(RATES)) + " FROM fo GROUP BY date"


def prices_index(spark, d):
    """The yearly change of a revised index as each release tells it."""
    return _vintages(spark, d).where("k = '1-URGENT'").select(F.col("realtime_start").alias("date"), F.col("yoy").alias("cpi_yoy"))


CTE["s_cpi"] = "SELECT rt AS date, yoy AS cpi_yoy FROM vknown WHERE k = '1-URGENT'"


def uncertainty(spark, d):
    """Two daily indices and their means over seven calendar days with four values at least. A row a day."""
    o = _orders(spark, d).groupBy("date").agg(*(F.avg(F.when(F.col("id") % 2 == i, F.col("v"))).alias(n) for i, n in enumerate(("epu_daily", "emu_daily"))))
    week = Window.orderBy(F.datediff("date", F.lit("1970-01-01").cast("date"))).rangeBetween(-6, 0)  # days of one calendar
    return o.withColumns({f"{n}_7d": F.when(F.count(n).over(week) >= 4, F.avg(n).over(week)) for n in ("epu_daily", "emu_daily")})


_WEEK = "OVER (ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)"
CTE["s_epu"] = "SELECT *, " + ", ".join(f"CASE WHEN count({n}) {_WEEK} >= 4 THEN avg({n}) {_WEEK} END AS {n}_7d" for n in ("epu_daily", "emu_daily")) + " FROM (SELECT date, avg(v) FILTER (id % 2 = 0) AS epu_daily, avg(v) FILTER (id % 2 = 1) AS emu_daily FROM fo GROUP BY date)"


def news(spark, d):
    """Share and tone of each topic by day."""
    of = lambda i: F.col("id") % 6 == i
    parts = [(F.count_if(of(i)) / F.count("*")).alias(f"{t}_news_share") for i, t in enumerate(TOPICS)] + [F.avg(F.when(of(i), F.col("v") / 99991 - 1.5)).alias(f"{t}_avg_tone") for i, t in enumerate(TOPICS)]
    return _orders(spark, d).groupBy("date").agg(*parts)


CTE["s_news"] = "SELECT date, " + ", ".join(f"count(*) FILTER (id % 6 = {i}) / count(*) AS {t}_news_share, avg(v / 99991 - 1.5) FILTER (id % 6 = {i}) AS {t}_avg_tone" for i, t in enumerate(TOPICS)) + " FROM fo GROUP BY date"


def tone(spark, d):
    """Tone of each statement, its exponential mean and its change since the statement before. A row a statement day."""
    score = F.when(F.col("id") % 3 == 0, 1.0).when(F.col("id") % 3 == 1, -1.0).otherwise(0.0) + F.col("c") % 10 / 10
    t = _orders(spark, d).where("p = '1-URGENT' and id % 11 = 0").groupBy("date").agg(F.avg(score).alias("net"))
    w = Window.orderBy("date")  # days of one calendar
    return t.select("date", F.col("net").alias("fomc_net_hawkish_last"), rolling.ewm("net", w, 3).alias("fomc_net_hawkish_ewma"), (F.col("net") - F.lag("net").over(w)).alias("fomc_tone_change"))


CTE["s_tone0"] = "SELECT date, net, row_number() OVER (ORDER BY date) AS i FROM (SELECT date, avg(CASE id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END + (c % 10) / 10) AS net FROM fo WHERE p = '1-URGENT' AND id % 11 = 0 GROUP BY date)"
CTE["s_tone"] = "SELECT a.date, any_value(a.net) AS fomc_net_hawkish_last, sum(b.net * power(0.5, (a.i - b.i) / 3.0)) / sum(power(0.5, (a.i - b.i) / 3.0)) AS fomc_net_hawkish_ewma, any_value(a.net) - max(CASE WHEN b.i = a.i - 1 THEN b.net END) AS fomc_tone_change FROM s_tone0 a JOIN s_tone0 b ON b.i BETWEEN a.i - 158 AND a.i GROUP BY a.date"


def filings(spark, d):
    """Counts of filings at the first session that closes after their acceptance."""
    o = _orders(spark, d).select("p", "date", (F.unix_timestamp("stamp") + F.col("id") * 7919 % 86400).cast("timestamp").alias("accepted"))
    at = align.first_close_after(o, session_map(spark, d), filed="date").where("available is not null")
    return at.groupBy(F.col("available").alias("date")).agg(F.count_if(F.col("p") == "1-URGENT").alias("sec_8k_count"), F.count("*").alias("sec_total_filings"), F.count_if(F.col("p") == "2-HIGH").alias("ndx_earnings_count"))


CTE["s_sec"] = "SELECT session_date AS date, count(*) FILTER (p = '1-URGENT') AS sec_8k_count, count(*) AS sec_total_filings, count(*) FILTER (p = '2-HIGH') AS ndx_earnings_count FROM (SELECT p, epoch(stamp) + (id * 7919) % 86400 AS s FROM fo) f ASOF JOIN sessions x ON f.s < x.close_s GROUP BY session_date"


def releases(spark, d):
    """0 or 1 for each session, null after the last release that is on the schedule."""
    s = sessions(spark, d).select(F.col("session_date").alias("date"))
    for name, some in (("is_cpi_day", "p = '2-HIGH' and id % 13 = 0"), ("is_nfp_day", "p = '3-MEDIUM' and id % 17 = 0")):
        due = _orders(spark, d).where(some).select("date").distinct()
        s = s.join(due.withColumn("hit", F.lit(1)), "date", "left").crossJoin(F.broadcast(due.agg(F.max("date").alias("through"))))  # one row
        s = s.withColumn(name, F.when(F.col("date") <= F.col("through"), F.coalesce("hit", F.lit(0)))).drop("hit", "through")
    return s


_DUE = {"is_cpi_day": "p = '2-HIGH' AND id % 13 = 0", "is_nfp_day": "p = '3-MEDIUM' AND id % 17 = 0"}
CTE["s_due"] = "SELECT session_date AS date, " + ", ".join(f"CASE WHEN session_date <= (SELECT max(date) FROM fo WHERE {x}) THEN CAST(session_date IN (SELECT date FROM fo WHERE {x}) AS INT) END AS {n}" for n, x in _DUE.items()) + " FROM sessions"

SOURCES = {"vol": volatility, "cross": cross_asset, "fred": rates, "cpi": prices_index, "epu": uncertainty, "gdelt": news, "tone": tone, "sec": filings, "due": releases}
_SQL = {"vol": "s_vol", "cross": "s_cross", "fred": "s_rates", "cpi": "s_cpi", "epu": "s_epu", "gdelt": "s_news", "tone": "s_tone", "sec": "s_sec", "due": "s_due"}

# the list --------------------------------------------------------------------------------------------------------------

_WHOLE = ("sec_8k_count", "sec_total_filings", "ndx_earnings_count")
INPUTS = [
    *(Input(c, "vol", c, ASOF, 1) for c in ("vxn_close", "vxn_minus_vix", "vix_term_ratio", "vix9d_ratio", "vvix")),
    *(Input(f"{c}_t0", "vol", c, ASOF, 0) for c in ("vxn_close", "vix_term_ratio")),
    *(Input(f"{n}_log_ret", "cross", f"{n}_log_ret", ASOF, 1 if n in ("oil", "dxy") else 0) for n in TICKERS),
    *(Input(f"{n}_lag1" if n not in ("dfii10", "t5yie") else n, "fred", n, SPREAD if n in ("t10y2y", "t5yie") else PUBLISHED) for n in RATES),
    Input("cpi_yoy", "cpi", "cpi_yoy"),
    *(Input(c, "epu", c, MEAN, 1) for c in ("epu_daily", "emu_daily", "epu_daily_7d", "emu_daily_7d")),
    *(Input(f"gdelt_{t}_{x}", "gdelt", f"{t}_{x}", MEAN, 1) for x in ("news_share", "avg_tone") for t in TOPICS),
    *(Input(c if c != "fomc_tone_change" else "fomc_tone_change_last", "tone", c) for c in ("fomc_net_hawkish_last", "fomc_net_hawkish_ewma", "fomc_tone_change")),
    *(Input(c, "sec", c, SESSION) for c in _WHOLE),
    *(Input(c, "due", c, SESSION) for c in _DUE),
]


def _price(name):
    return lambda w: rolling.price_features(w)[name]


def _change(c, scale=1.0):
    return lambda w: (F.col(c) - F.lag(c).over(w)) * scale


def _log_change(c):
    return lambda w: F.ln(F.col(c)) - F.ln(F.lag(c).over(w))


def _minus(a, b):
    return lambda w: F.col(a) - F.col(b)


def _ln(c):
    return lambda w: F.ln(F.col(c))


def _same(c):
    return lambda w: F.col(c)


FEATURES = [
    Feature("log_return_1d", "target", "target", _same("y")),
    *(Feature(c, "raw", "raw") for c in ("open", "high", "low", "close", "adj_close", "volume")),
    Feature("overnight_gap", "qqq", "past", _price("overnight_gap")),
    Feature("parkinson_vol_1d", "qqq", "past", lambda w: F.sqrt(F.pow(F.ln(ratio(F.col("high"), F.col("low"))), 2) / F.lit(4 * 0.6931471805599453))),
    Feature("parkinson_vol_22d", "qqq", "past", _price("range_vol")),
    Feature("volatility_20d", "qqq", "past", lambda w: over(F.stddev_samp, "y", w, 20)),
    Feature("volume_z_20d", "qqq", "past", _price("volume_z")),
    Feature("volume_change_1d", "qqq", "past", lambda w: pct_change("volume", w)),
    *(Feature(n, "qqq", "past", _price(c)) for n, c in (("mom_21d", "momentum_21"), ("mom_63d", "momentum_63"), ("dist_50dma", "dist_ma50"), ("dist_200dma", "dist_ma200"))),
    Feature("vxn_close", "market", "past"),
    Feature("vxn_log_chg", "market", "past", _log_change("vxn_close")),
    *(Feature(c, "market", "past") for c in ("vxn_minus_vix", "vix_term_ratio", "vix9d_ratio")),
    Feature("vvix_log_chg", "market", "past", _log_change("vvix")),
    Feature("vxn_log_chg_t0", "market_t0", "past", _log_change("vxn_close_t0")),
    Feature("vix_term_ratio_t0", "market_t0", "past"),
    *(Feature(c, "market", "past") for c in ("tlt_log_ret", "hyg_log_ret")),
    Feature("qqq_minus_spy", "market", "past", _minus("y", "spy_log_ret")),
    Feature("iwm_minus_spy", "market", "past", _minus("iwm_log_ret", "spy_log_ret")),
    Feature("smh_minus_qqq", "market", "past", _minus("smh_log_ret", "y")),
    *(Feature(c, "market", "past") for c in ("gld_log_ret", "oil_log_ret", "dxy_log_ret")),
    *(Feature(f"d_{n}_bp", "rates", "past", _change(n if n in ("dfii10", "t5yie") else f"{n}_lag1", 100.0)) for n in RATES),
    *(Feature(c, "rates", "past") for c in ("t10y2y_lag1", "cpi_yoy")),
    *(Feature(n, "uncertainty", "past", _ln(c)) for n, c in (("epu_log", "epu_daily_7d"), ("emu_log", "emu_daily_7d"), ("epu_log_1d", "epu_daily"), ("emu_log_1d", "emu_daily"))),
    *(Feature(f"gdelt_{t}_{x}", "news", "past") for x in ("news_share", "avg_tone") for t in TOPICS),
    *(Feature(c, "fed", "past") for c in ("fomc_net_hawkish_last", "fomc_net_hawkish_ewma", "fomc_tone_change_last")),
    Feature("days_since_fomc", "fed", "past", _same("days_since_event")),
    *(Feature(c, "sec", "past") for c in ("ndx_earnings_count", "sec_8k_count", "sec_total_filings")),
    *(Feature(n, "calendar", "known_future", _same(c)) for n, c in (("is_fomc_day", "is_event_day"), ("days_to_fomc", "days_to_event"), ("is_fomc_day_before", "is_event_day_before"), ("fomc_cycle_week", "cycle_week"))),
    *(Feature(c, "calendar", "known_future") for c in (*_DUE, "is_month_end", "is_quarter_end", "days_to_month_end", "is_opex_day", "is_opex_week", "is_quad_witching", "day_of_week", "is_pre_holiday")),
]
NAMES = [f.name for f in FEATURES]
_EXACT = {f.name for f in FEATURES if f.group in ("calendar", "sec")} | {"days_since_fomc", "volume"}
#: The compact set of covariates.
CORE = ["overnight_gap", "parkinson_vol_1d", "parkinson_vol_22d", "volume_z_20d", "mom_21d", "dist_200dma", "vxn_log_chg", "vxn_minus_vix", "vix_term_ratio", "tlt_log_ret", "hyg_log_ret", "d_dgs2_bp", "t10y2y_lag1", "d_dfii10_bp", "cpi_yoy", "epu_log", "emu_log", "fomc_net_hawkish_ewma", "gdelt_fed_news_share", "gdelt_ai_news_share", "ndx_earnings_count", "is_fomc_day", "is_cpi_day", "is_nfp_day", "days_to_fomc", "days_to_month_end", "is_opex_week"]

# SQL of the same -------------------------------------------------------------------------------------------------------

_EDGE = "(SELECT next_on_or_after FROM daymap, span WHERE date = {})"


def _available(i: Input) -> str:
    src = _SQL[i.source]
    if i.rule == ASOF:
        return f"SELECT date AS ref, date + {i.lag} AS avail, {i.column} AS x FROM {src}"
    cut = f"CASE WHEN o.date >= DATE '{CUTOVER}' THEN o.date ELSE f.next_after END" if i.rule == SPREAD else "f.next_after"
    return f"SELECT o.date AS ref, s.next_after AS avail, o.{i.column} AS x FROM {src} o LEFT JOIN fedmap f ON f.date = o.date LEFT JOIN daymap s ON s.date = {cut}"


def _aligned_sql() -> str:
    asof = [i for i in INPUTS if i.rule in (ASOF, PUBLISHED, SPREAD)]
    joins = " ".join(f"ASOF LEFT JOIN (SELECT avail, last(x ORDER BY ref) AS x FROM ({_available(i)}) WHERE x IS NOT NULL AND avail IS NOT NULL GROUP BY avail) j{n} ON b.date >= j{n}.avail" for n, i in enumerate(asof))
    means, cols = "", [f"j{n}.x AS {i.name}" for n, i in enumerate(asof)]
    for source in dict.fromkeys(i.source for i in INPUTS if i.rule == MEAN):
        own = [i for i in INPUTS if i.rule == MEAN and i.source == source]
        means += f" LEFT JOIN (SELECT greatest(next_on_or_after, {_EDGE.format('lo')}) AS date, {', '.join(f'avg({i.column}) AS {i.name}' for i in own)} FROM {_SQL[source]} e JOIN daymap m ON m.date = e.date + {own[0].lag} WHERE greatest(next_on_or_after, {_EDGE.format('lo')}) <= {_EDGE.format('hi')} GROUP BY 1) m_{source} ON m_{source}.date = b.date"
        cols += [i.name for i in own]
    for source in dict.fromkeys(i.source for i in INPUTS if i.rule == SESSION):
        means += f" LEFT JOIN {_SQL[source]} e_{source} ON e_{source}.date = b.date"
        cols += [f"e_{source}.{i.name}" for i in INPUTS if i.rule == SESSION and i.source == source]
    return f"SELECT b.date, {', '.join(cols)} FROM (SELECT session_date AS date FROM sessions) b {joins}{means}"


def _feature_sql(f: Feature) -> str:
    lag = lambda c: f"lag({c}) OVER w"
    logs = {"vxn_log_chg": "vxn_close", "vvix_log_chg": "vvix", "vxn_log_chg_t0": "vxn_close_t0"}
    made = {
        "log_return_1d": "y", "parkinson_vol_1d": "hl", "parkinson_vol_22d": "range_vol", "volatility_20d": _roll("stddev_samp", "y", 20), "volume_z_20d": "volume_z", "volume_change_1d": f"volume / {lag('volume')} - 1",
        "mom_21d": "momentum_21", "mom_63d": "momentum_63", "dist_50dma": "dist_ma50", "dist_200dma": "dist_ma200",
        "qqq_minus_spy": "y - spy_log_ret", "iwm_minus_spy": "iwm_log_ret - spy_log_ret", "smh_minus_qqq": "smh_log_ret - y",
        "epu_log": "ln(epu_daily_7d)", "emu_log": "ln(emu_daily_7d)", "epu_log_1d": "ln(epu_daily)", "emu_log_1d": "ln(emu_daily)",
        "days_since_fomc": "days_since_event", "is_fomc_day": "is_event_day", "days_to_fomc": "days_to_event", "is_fomc_day_before": "is_event_day_before", "fomc_cycle_week": "cycle_week",
    }
    if f.name in logs:
        return f"ln({logs[f.name]}) - ln({lag(logs[f.name])})"
    if f.name.startswith("d_"):
        c = f.name[2:-3]
        c = c if c in ("dfii10", "t5yie") else f"{c}_lag1"
        return f"100 * ({c} - {lag(c)})"
    return made.get(f.name, f.name)


CTE["al"] = _aligned_sql()
CTE["daily0"] = f"SELECT f.*, s.adj_close, sqrt(ln(f.high / f.low) ** 2 / (4 * ln(2))) AS hl, al.* EXCLUDE (date), cal.* EXCLUDE (date) FROM feats f JOIN series s ON s.k = f.k AND s.date = f.date LEFT JOIN al ON al.date = f.date LEFT JOIN (SELECT * FROM cal WHERE date BETWEEN (SELECT lo FROM span) AND (SELECT hi FROM span)) cal ON cal.date = f.date"
CTE["daily"] = f"SELECT k, date, idx, {', '.join(f'{_feature_sql(f)} AS {f.name}' for f in FEATURES)} FROM daily0 WINDOW w AS (PARTITION BY k ORDER BY date)"


def _places(name):
    return 6 if name.startswith(("log_", "volume_change", "open", "high", "low", "close", "adj")) else 4


def _rounded_sql(names):
    return ", ".join(n if n in _EXACT else f"round({n}, {_places(n)}) AS {n}" for n in names)


def _rounded(names):
    return [F.col(n) if n in _EXACT else r(n, places=_places(n)) for n in names]


# queries ---------------------------------------------------------------------------------------------------------------


def daily(spark, d):
    """k, date, idx and every feature, before the warm-up is cut."""
    ends = {r.date: r.next_on_or_after for r in session_map(spark, d).where(F.col("date").isin(*traded(spark, d))).collect()}  # two rows
    first, last = (ends[x] for x in traded(spark, d))
    days = sessions(spark, d).select(F.col("session_date").alias("date"))
    wide = features.aligned(days, {n: f(spark, d) for n, f in SOURCES.items()}, INPUTS, business_map(spark, d), session_map(spark, d), first, last, CUTOVER)
    wide = wide.join(_calendar(spark, d), "date", "left")
    w = by("k")
    base = series(spark, d).withColumn("idx", F.row_number().over(w).cast("long")).withColumn("y", log_return("close", w))
    return features.table(base, wide, FEATURES, w, ["k", "date", "idx"])


_CUT = f"log_return_1d IS NOT NULL AND idx > {_WARM}"


@query("daily_features", f"SELECT k, date, {_rounded_sql(NAMES)} FROM daily WHERE {_CUT}")
def daily_features(spark, d):
    return daily(spark, d).where(_CUT).select("k", "date", *_rounded(NAMES))


@query("daily_features_core", f"SELECT k, date, {_rounded_sql(['log_return_1d', *CORE])} FROM daily WHERE {_CUT}")
def daily_features_core(spark, d):
    return daily(spark, d).where(_CUT).select("k", "date", *_rounded(["log_return_1d", *CORE]))


_ROLES = features.roles(FEATURES)


@query("daily_feature_roles", f"SELECT c AS \"column\", g AS \"group\", r AS role, n AS n_values FROM (VALUES {', '.join(f'({c!r}, {g!r}, {x!r})' for c, g, x in _ROLES)}) t(c, g, r) JOIN (UNPIVOT (SELECT {', '.join(f'count({c}) AS {c}' for c in NAMES)} FROM daily WHERE {_CUT}) ON {', '.join(NAMES)} INTO NAME c VALUE n) USING (c)")
def daily_feature_roles(spark, d):
    counts = daily(spark, d).where(_CUT).agg(*(F.count(c).alias(c) for c in NAMES))
    told = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(g).alias("group"), F.lit(x).alias("role"), F.col(c).alias("n_values")) for c, g, x in _ROLES)))
    return counts.select(told.alias("x")).select("x.*")
