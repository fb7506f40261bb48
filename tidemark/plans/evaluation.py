"""Rolling-origin windows, forecasts of two models in runs of several look-backs, seeds and years, their scores, paired statistics and importance."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import pinball as loss
from tidemark.functions.scalars import ratio
from tidemark.operators import align, calendar, resample, rolling, score, windows
from tidemark.operators.forecast import forecast
from tidemark.operators.rolling import by
from tidemark.plans.base import CTE, bars, once, query, r, rets, session_map, sessions
from tidemark.plans.market import _calendar, feature_frame, features
from tidemark.sources import sinks

RUNGS, SEEDS, YEARS = (20, 60, 120), (0, 1, 2), (1997, 1998, 1999)
HORIZON, STRIDE = 5, 5
CELL = ["rung", "fold", "seed"]

# SQL of the same frames ------------------------------------------------------------------------------------------------


def _frame(n):
    return f"OVER (PARTITION BY k ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_Z, _L = (f"[{', '.join(map(repr, x))}]" for x in (score.Z, score.LEVELS))
CTE["folds"] = f"SELECT *, CAST(year(date) AS INT) AS fold FROM rets WHERE y IS NOT NULL AND year(date) IN {YEARS}"
CTE["org"] = f"SELECT k, fold, (idx - lo) // {STRIDE} AS window_id, idx - 1 AS origin FROM (SELECT k, fold, idx, min(idx) OVER (PARTITION BY k, fold) AS lo, max(idx) OVER (PARTITION BY k, fold) AS hi FROM folds) WHERE (idx - lo) % {STRIDE} = 0 AND idx + {HORIZON - 1} <= hi"
CTE["tgt"] = f"SELECT o.k, o.fold, o.window_id, o.origin, h.h AS horizon, t.date, t.y AS actual, b.date AS forecast_origin FROM org o CROSS JOIN (SELECT CAST(unnest(range(1, {HORIZON + 1})) AS INT) AS h) h JOIN rets t ON t.k = o.k AND t.idx = o.origin + h.h JOIN rets b ON b.k = o.k AND b.idx = o.origin"
CTE["sigmas"] = "SELECT k, idx AS origin, " + ", ".join(f"stddev_samp(y) {_frame(n + s)} AS s{n + s}, avg(y) {_frame(n + s)} AS m{n + s}" for n in RUNGS for s in SEEDS) + " FROM rets"
CTE["cells"] = " UNION ALL ".join(f"SELECT k, origin, {n} AS rung, {s} AS seed, '{m}' AS model, {f'm{n + s}' if m == 'tuned' else '0.0'} AS shift, {f's{n + s}' if m == 'tuned' else 's60'} AS sigma FROM sigmas" for n in RUNGS for s in SEEDS for m in ("base", "tuned"))
CTE["preds"] = f"SELECT t.*, c.rung, c.seed, c.model, c.sigma, c.shift AS prediction, [c.shift + c.sigma * z FOR z IN {_Z}] AS q FROM tgt t JOIN cells c ON t.k = c.k AND t.origin = c.origin"
CTE["scored"] = f"""SELECT *, prediction - actual AS error, abs(prediction - actual) AS abs_error, (prediction - actual) ** 2 AS squared_error, CAST((prediction >= 0) = (actual >= 0) AS INT) AS correct_direction,
 CAST(actual BETWEEN q[3] AND q[19] AS INT) AS interval_hit, q[19] - q[3] AS interval_width, CAST(actual BETWEEN q[1] AND q[21] AS INT) AS tail_hit, list_avg([greatest({_L}[i] * (actual - q[i]), ({_L}[i] - 1) * (actual - q[i])) FOR i IN range(1, 22)]) AS pinball FROM preds"""
_METRICS = {"rmse": "sqrt(avg(squared_error))", "mae": "avg(abs_error)", "bias": "avg(error)", "directional_accuracy": "avg(correct_direction)", "mean_prediction": "avg(prediction)", "mean_actual": "avg(actual)", "coverage": "avg(interval_hit)", "tail_coverage": "avg(tail_hit)", "width": "avg(interval_width)", "mean_pinball": "avg(pinball)", "wql": "2 * avg(pinball) / avg(abs(actual))"}
_ALL = ", ".join(f"{e} AS {n}" for n, e in _METRICS.items())
CTE["wfold"] = "SELECT rung, fold, seed, model, k, window_id, 2 * avg(pinball) / max(s) AS wql, max(forecast_origin) AS forecast_origin FROM (SELECT *, avg(abs(actual)) OVER (PARTITION BY rung, fold, seed, model) AS s FROM scored) GROUP BY ALL"
CTE["wfold"] = CTE["wfold"].replace("GROUP BY ALL", "GROUP BY rung, fold, seed, model, k, window_id")
CTE["wown"] = "SELECT rung, fold, seed, model, k, window_id, 2 * avg(pinball) / avg(abs(actual)) AS wql FROM scored GROUP BY rung, fold, seed, model, k, window_id"
CTE["seedmean"] = "SELECT rung, fold, model, k, window_id, avg(wql) AS wql FROM wfold GROUP BY rung, fold, model, k, window_id"
CTE["deltas"] = "SELECT a.rung, a.fold, a.k, a.window_id, a.wql - b.wql AS delta FROM seedmean a JOIN seedmean b ON a.rung = b.rung AND a.fold = b.fold AND a.k = b.k AND a.window_id = b.window_id WHERE a.model = 'tuned' AND b.model = 'base'"
CTE["versus"] = "SELECT a.rung, a.fold, a.k, a.window_id, a.wql - b.wql AS delta FROM seedmean a JOIN seedmean b ON a.fold = b.fold AND a.k = b.k AND a.window_id = b.window_id WHERE a.model = 'tuned' AND b.model = 'tuned' AND b.rung = 60 AND a.rung <> 60"
CTE["runwql"] = "SELECT rung, fold, seed, model, 2 * avg(pinball) / avg(abs(actual)) AS wql FROM scored GROUP BY rung, fold, seed, model"
CTE["realised"] = f"SELECT k, idx AS origin, stddev_samp(y) {_frame(20)} AS vol FROM rets"

# frames ----------------------------------------------------------------------------------------------------------------


def folded(spark, d):
    return rets(spark, d).where(F.col("y").isNotNull()).withColumn("fold", F.year("date")).where(F.col("fold").isin(*YEARS))


def targets(spark, d):
    s = rets(spark, d)
    o = windows.origins(folded(spark, d), ["k", "fold"], HORIZON, STRIDE)
    return windows.targets(o, s, ["k"], HORIZON, "y")


def predictions(spark, d):
    """Rows of two models in every cell: a zero-mean normal of sixty sessions and one with the cell's look-back and drift."""
    w = by("k")
    cells = []
    for n in RUNGS:
        for s in SEEDS:
            frame = w.rowsBetween(1 - n - s, 0)
            for model in ("base", "tuned"):
                shift = F.avg("y").over(frame) if model == "tuned" else F.lit(0.0)
                sigma = F.stddev_samp("y").over(frame if model == "tuned" else w.rowsBetween(-59, 0))
                cells.append(F.struct(F.lit(n).alias("rung"), F.lit(s).alias("seed"), F.lit(model).alias("model"), shift.alias("prediction"), sigma.alias("sigma")))
    at = rets(spark, d).select("k", F.col("idx").alias("origin"), F.array(*cells).alias("cells"))
    rows = targets(spark, d).join(at, ["k", "origin"]).select("k", "fold", "window", "origin", "horizon", "date", "actual", "forecast_origin", F.explode("cells").alias("c")).select("*", "c.*").drop("c")
    return rows.withColumn("q", F.transform(score.gaussian_quantiles(F.col("sigma")), lambda x: x + F.col("prediction")))


def scored(spark, d):
    return score.with_errors(predictions(spark, d))


def window_scores(spark, d, own: bool = False):
    keys = [*CELL, "model", "k"]
    return score.window_wql(predictions(spark, d), keys, [*keys, "window"] if own else [*CELL, "model"])


def seed_means(spark, d):
    return window_scores(spark, d).groupBy("rung", "fold", "model", "k", "window").agg(F.avg("wql").alias("wql"))


def paired(rows: DataFrame, keys: list[str], value: str = "wql") -> DataFrame:
    """keys, delta = tuned - base, both sides from one pass; pairs with a missing side are left out."""
    side = lambda model: F.max(F.when(F.col("model") == model, F.col(value)))
    return rows.groupBy(*keys).agg((side("tuned") - side("base")).alias("delta")).where("delta is not null")


_KEYS = ["rung", "fold", "k", "window"]


def deltas(spark, d):
    return paired(seed_means(spark, d), _KEYS)


def versus_control(spark, d):
    s = seed_means(spark, d).where("model = 'tuned'")
    each = s.groupBy("fold", "k", "window").agg(F.max(F.when(F.col("rung") == 60, F.col("wql"))).alias("c"), F.collect_list(F.when(F.col("rung") != 60, F.struct("rung", "wql"))).alias("others"))  # one a rung
    return each.where("c is not null").select("fold", "k", "window", "c", F.explode("others").alias("o")).select(F.col("o.rung").alias("rung"), "fold", "k", "window", (F.col("o.wql") - F.col("c")).alias("delta"))


def run_wql(spark, d):
    return scored(spark, d).groupBy(*CELL, "model").agg((2 * ratio(F.avg("pinball"), F.avg(F.abs("actual")))).alias("wql"))


# windows ---------------------------------------------------------------------------------------------------------------


def _parts(df):
    return df.groupBy("k", "part").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


_PARTS = "SELECT k, part, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM (SELECT k, date, CASE WHEN idx > n - {rows} THEN 'validation' ELSE 'train' END AS part FROM (SELECT k, date, idx, count(*) OVER (PARTITION BY k) AS n FROM rets)) GROUP BY k, part"


@query("train_validation_split", _PARTS.format(rows=250))
def train_validation_split(spark, d):
    return _parts(windows.split_by_rows(rets(spark, d), ["k"], 250))


@query("fraction_split", _PARTS.format(rows=f"greatest({4 * HORIZON}, CAST(round_even(n * 0.15, 0) AS BIGINT))"))
def fraction_split(spark, d):
    return _parts(windows.split_by_fraction(rets(spark, d), ["k"], 0.15, HORIZON))


@query("fold_bounds", "SELECT k, fold, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows FROM folds GROUP BY k, fold")
def fold_bounds(spark, d):
    return folded(spark, d).groupBy("k", "fold").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_rows"))


@query("rolling_windows", "SELECT k, fold, window_id AS \"window\", horizon, date, forecast_origin, round(actual, 6) AS actual FROM tgt")
def rolling_windows(spark, d):
    return targets(spark, d).select("k", "fold", "window", "horizon", "date", "forecast_origin", r("actual"))


@query("context_arrays", f"SELECT o.k, o.fold, o.window_id AS \"window\", least(o.origin, 20) AS n, round(c.total, 5) AS total, c.n_null FROM org o JOIN (SELECT k, idx, sum(y) {_frame(20)} AS total, count(*) {_frame(20)} - count(y) {_frame(20)} AS n_null FROM rets) c ON c.k = o.k AND c.idx = o.origin")
def context_arrays(spark, d):
    o = windows.origins(folded(spark, d), ["k", "fold"], HORIZON, STRIDE)
    c = windows.context(rets(spark, d), ["k"], ["y"], 20).select("k", F.col("idx").alias("origin"), "y_context").join(o, ["k", "origin"])
    there = F.filter("y_context", lambda x: x.isNotNull())
    return c.select("k", "fold", "window", F.size("y_context").cast("long").alias("n"), r(F.aggregate(there, F.lit(0.0), lambda s, x: s + x), "total", 5), (F.size("y_context") - F.size(there)).cast("long").alias("n_null"))


_AHEAD = f"OVER (PARTITION BY k ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {HORIZON} FOLLOWING)"


@query("future_block", f"SELECT k, idx, CAST(ev AS INT) AS events_ahead, CAST(dd AS INT) AS weekday_sum FROM (SELECT k, idx, sum(is_event_day) {_AHEAD} AS ev, sum(day_of_week) {_AHEAD} AS dd, count(is_event_day) {_AHEAD} AS n1, count(days_to_event) {_AHEAD} AS n2 FROM ftable) WHERE n1 = {HORIZON} AND n2 = {HORIZON}")
def future_block(spark, d):
    f = windows.future(feature_frame(spark, d), ["k"], ["is_event_day", "day_of_week", "days_to_event"], HORIZON)
    add = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x.cast("int"))
    return f.select("k", "idx", add("is_event_day_future").alias("events_ahead"), add("day_of_week_future").alias("weekday_sum"))


@query("horizon_covered", f"SELECT o.k, o.fold, o.origin, coalesce(bool_and(f.is_event_day IS NOT NULL AND f.days_to_event IS NOT NULL), false) AND count(f.k) = {HORIZON} AS covered FROM org o LEFT JOIN ftable f ON f.k = o.k AND f.idx > o.origin AND f.idx <= o.origin + {HORIZON} GROUP BY ALL")
def horizon_covered(spark, d):
    o = windows.origins(folded(spark, d), ["k", "fold"], HORIZON, STRIDE).select("k", "fold", F.col("origin").alias("idx"))
    days = feature_frame(spark, d).select("k", "idx", "is_event_day", "days_to_event").join(o.select("k", "fold").distinct(), "k")
    return align.horizon_covered(o, days, ["k", "fold"], HORIZON, ["is_event_day", "days_to_event"])


@query("holdout_split", f"SELECT a.k, a.n_context, h.idx - a.n_context AS horizon, h.date, round(h.y, 6) AS actual FROM (SELECT k, count(*) - 60 AS n_context FROM rets GROUP BY k) a JOIN rets h ON h.k = a.k AND h.idx > a.n_context AND h.idx <= a.n_context + {HORIZON}")
def holdout_split(spark, d):
    parts = windows.split_by_rows(rets(spark, d), ["k"], 60).withColumn("n_context", F.count_if(F.col("part") == "train").over(Window.partitionBy("k")))
    return parts.where((F.col("part") == "validation") & (F.col("idx") <= F.col("n_context") + HORIZON)).select("k", "n_context", (F.col("idx") - F.col("n_context")).alias("horizon"), "date", r("y", "actual"))


@query("live_horizon", "SELECT b.k, b.last_date, s.session_date AS date, CAST(s.idx - b.at AS INT) AS step FROM (SELECT k, last_date, (SELECT count(*) FROM sessions WHERE session_date <= last_date) AS at FROM (SELECT k, max(date) AS last_date FROM bars GROUP BY k)) b JOIN sessions s ON s.idx > b.at AND s.idx <= b.at + 5")
def live_horizon(spark, d):
    s = sessions(spark, d)
    last = bars(spark, d).groupBy("k").agg(F.max("date").alias("last_date"))
    nxt = last.join(F.broadcast(session_map(spark, d).select(F.col("date").alias("last_date"), "next_after")), "last_date").join(F.broadcast(s.select(F.col("session_date").alias("next_after"), "idx")), "next_after")
    ahead = nxt.select("k", "last_date", F.posexplode(F.sequence("idx", F.col("idx") + 4)).alias("p", "idx"))
    return ahead.join(F.broadcast(s.select("idx", F.col("session_date").alias("date"))), "idx").select("k", "last_date", "date", (F.col("p") + 1).alias("step"))


@query("training_arrays", "SELECT k, count(*) AS n, round(sum(y * idx), 2) AS weighted FROM rets GROUP BY k")
def training_arrays(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("idx", "y")))
    a = rets(spark, d).groupBy("k").agg(rows.alias("s")).select("k", F.transform("s", lambda x: x["y"]).alias("y"))
    return a.select("k", F.size("y").cast("long").alias("n"), r(F.aggregate(F.transform("y", lambda y, i: F.coalesce(y * (i + 1), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x), "weighted", 2))


# scores ----------------------------------------------------------------------------------------------------------------

_ID = "k, rung, fold, seed, model, window_id AS \"window\", horizon"
_IDS = ["k", "rung", "fold", "seed", "model", "window", "horizon"]


@query("gaussian_baseline", f"SELECT {_ID}, round(q[3], 6) AS q10, round(q[11], 6) AS q50, round(q[19], 6) AS q90, prediction FROM preds WHERE model = 'base' AND rung = 60")
def gaussian_baseline(spark, d):
    return predictions(spark, d).where("model = 'base' and rung = 60").select(*_IDS, *(r(score.level("q", p), n) for p, n in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90"))), "prediction")


@query("forecast_errors", f"SELECT {_ID}, round(error, 6) AS error, round(abs_error, 6) AS abs_error, round(squared_error, 6) AS squared_error, correct_direction, interval_hit, round(interval_width, 6) AS interval_width FROM scored WHERE seed = 0")
def forecast_errors(spark, d):
    return scored(spark, d).where("seed = 0").select(*_IDS, r("error"), r("abs_error"), r("squared_error"), "correct_direction", "interval_hit", r("interval_width"))


@query("pinball", f"SELECT {_ID}, round(pinball, 6) AS pinball FROM scored WHERE seed = 0")
def pinball(spark, d):
    return scored(spark, d).where("seed = 0").select(*_IDS, r("pinball"))


@query("wql", "SELECT rung, fold, seed, model, round(wql, 6) AS wql FROM runwql")
def wql(spark, d):
    return run_wql(spark, d).select(*CELL, "model", r("wql"))


_R = ", ".join(f"round({n}, 6) AS {n}" for n in _METRICS)


@query("metrics_grouping_sets", f"SELECT rung, fold, seed, model, horizon, n_rows, {_R} FROM (SELECT rung, fold, seed, model, CAST(horizon AS VARCHAR) AS horizon, count(*) AS n_rows, {_ALL} FROM scored GROUP BY rung, fold, seed, model, horizon UNION ALL SELECT rung, fold, seed, model, 'overall', count(*), {_ALL} FROM scored GROUP BY rung, fold, seed, model)")
def metrics_grouping_sets(spark, d):
    return score.metrics(scored(spark, d), [*CELL, "model"]).select(*CELL, "model", "horizon", "n_rows", *map(r, _METRICS))


for _name, _own, _cte in (("window_wql_fold", False, "wfold"), ("window_wql_own", True, "wown")):

    @query(_name, f"SELECT rung, fold, seed, model, k, window_id AS \"window\", round(wql, 6) AS wql FROM {_cte}")
    def _window_wql(spark, d, own=_own):
        return window_scores(spark, d, own).select(*CELL, "model", "k", "window", r("wql"))


@query("quantile_crossing", "SELECT model, count(*) AS n_rows, CAST(sum(len([i FOR i IN range(1, 21) IF q[i + 1] - q[i] < -1e-8])) AS BIGINT) AS n_crossings, round(max(-list_min([q[i + 1] - q[i] FOR i IN range(1, 21)])), 6) AS largest FROM preds GROUP BY model")
def quantile_crossing(spark, d):
    p = predictions(spark, d)
    least = F.array_min(F.zip_with(F.slice("q", 2, 20), F.slice("q", 1, 20), lambda b, a: b - a))
    return p.groupBy("model").agg(F.count("*").alias("n_rows"), F.sum(score.crossings(F.col("q"))).alias("n_crossings"), r(F.max(-least), "largest"))


#: How metrics are compared.
_LOWER, _HIGHER = ("mae", "rmse", "mean_pinball", "wql"), ("directional_accuracy",)
_CMP = [*_LOWER, *_HIGHER, "coverage", "width"]


@query("metric_deltas", f"""SELECT rung, fold, seed, metric, round(base, 6) AS base, round(tuned, 6) AS tuned, round(CASE WHEN metric IN {_LOWER} THEN 100 * (tuned - base) / base WHEN metric = 'coverage' THEN abs(tuned - 0.8) - abs(base - 0.8) ELSE tuned - base END, 5) AS delta,
 CASE WHEN metric IN {_LOWER} THEN CASE WHEN tuned < base THEN 'tuned' ELSE 'base' END WHEN metric = 'directional_accuracy' THEN CASE WHEN tuned > base THEN 'tuned' ELSE 'base' END WHEN metric = 'coverage' THEN CASE WHEN abs(tuned - 0.8) < abs(base - 0.8) THEN 'tuned' ELSE 'base' END END AS winner
 FROM (SELECT rung, fold, seed, metric, max(v) FILTER (model = 'base') AS base, max(v) FILTER (model = 'tuned') AS tuned FROM (UNPIVOT (SELECT rung, fold, seed, model, {', '.join(f'{_METRICS[m]} AS {m}' for m in _CMP)} FROM scored GROUP BY rung, fold, seed, model) ON {', '.join(_CMP)} INTO NAME metric VALUE v) GROUP BY rung, fold, seed, metric)""")
def metric_deltas(spark, d):
    m = scored(spark, d).groupBy(*CELL, "model").agg(*score.metric_columns())
    long = m.select(*CELL, "model", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in _CMP))).alias("x")).select(*CELL, "model", "x.*")
    both = long.groupBy(*CELL, "metric").agg(F.max(F.when(F.col("model") == "base", F.col("v"))).alias("base"), F.max(F.when(F.col("model") == "tuned", F.col("v"))).alias("tuned"))
    a, b, name = F.col("tuned"), F.col("base"), F.col("metric")
    gap = F.abs(a - 0.8) - F.abs(b - 0.8)
    delta = F.when(name.isin(*_LOWER), 100 * ratio(a - b, b)).when(name == "coverage", gap).otherwise(a - b)
    pick = lambda c: F.when(c, "tuned").otherwise("base")  # noqa: E731  ties go to the base
    winner = F.when(name.isin(*_LOWER), pick(a < b)).when(name.isin(*_HIGHER), pick(a > b)).when(name == "coverage", pick(F.abs(a - 0.8) < F.abs(b - 0.8)))
    return both.select(*CELL, "metric", r("base"), r("tuned"), r(delta, "delta", 5), winner.alias("winner"))


@query("coverage_direction", "SELECT rung, fold, model, round(avg(interval_hit), 6) AS coverage, round(avg(correct_direction), 6) AS direction, round(avg(CAST(actual >= 0 AS INT)), 6) AS up_rate FROM scored GROUP BY rung, fold, model")
def coverage_direction(spark, d):
    return scored(spark, d).groupBy("rung", "fold", "model").agg(r(F.avg("interval_hit"), "coverage"), r(F.avg("correct_direction"), "direction"), r(F.avg((F.col("actual") >= 0).cast("int")), "up_rate"))


@query("run_contract_audit", "SELECT rung, fold, seed, count(*) AS n_keys, count(*) FILTER (nb = 1 AND nt = 1) AS n_paired, round(max(abs(ab - lt)), 6) AS label_gap FROM (SELECT rung, fold, seed, k, window_id, horizon, count(*) FILTER (model = 'base') AS nb, count(*) FILTER (model = 'tuned') AS nt, max(actual) FILTER (model = 'base') AS ab, max(actual) FILTER (model = 'tuned') AS lt FROM preds GROUP BY ALL) GROUP BY rung, fold, seed")
def run_contract_audit(spark, d):
    one = lambda m: F.when(F.col("model") == m, F.col("actual"))
    p = predictions(spark, d).groupBy(*CELL, "k", "window", "horizon").agg(F.count(one("base")).alias("nb"), F.count(one("tuned")).alias("nt"), F.max(one("base")).alias("ab"), F.max(one("tuned")).alias("at"))
    return p.groupBy(*CELL).agg(F.count("*").alias("n_keys"), F.count_if((F.col("nb") == 1) & (F.col("nt") == 1)).alias("n_paired"), r(F.max(F.abs(F.col("ab") - F.col("at"))), "label_gap"))


@query("forecast_frame", f"SELECT {_ID}, date, round(q[11], 6) AS median, round(actual, 6) AS actual, round(error, 6) AS error FROM scored WHERE rung = 60 AND seed = 0 AND model = 'tuned'")
def forecast_frame(spark, d):
    return scored(spark, d).where("rung = 60 and seed = 0 and model = 'tuned'").select(*_IDS, "date", r(score.level("q", 0.5), "median"), r("actual"), r("error"))


CTE["gains"] = "SELECT x.rung, x.fold, x.k, x.window_id, x.delta, v.vol, o.origin, date_trunc('week', b.date) AS week FROM deltas x JOIN org o ON o.k = x.k AND o.fold = x.fold AND o.window_id = x.window_id JOIN realised v ON v.k = o.k AND v.origin = o.origin JOIN rets b ON b.k = o.k AND b.idx = o.origin"


def gains(spark, d):
    s = rets(spark, d).select("k", F.col("idx").alias("origin"), F.stddev_samp("y").over(by("k").rowsBetween(-19, 0)).alias("vol"), F.date_trunc("week", "date").alias("week"))
    o = windows.origins(folded(spark, d), ["k", "fold"], HORIZON, STRIDE)
    return deltas(spark, d).join(o, ["k", "fold", "window"]).join(s, ["k", "origin"])


def tercile(value: str, edges: str) -> F.Column:
    low, high = F.col(edges)[0], F.col(edges)[1]
    return F.when(F.col(value) <= low, "low").when(F.col(value) <= high, "middle").otherwise("high")


def _by_tercile(g: DataFrame, keys: list[str]) -> DataFrame:
    edges = g.groupBy(*keys).agg(F.percentile("vol", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("edges"))
    return g.join(edges, keys).withColumn("tercile", tercile("vol", "edges"))


_EDGE = "CASE WHEN vol <= lo THEN 'low' WHEN vol <= hi THEN 'middle' ELSE 'high' END"


@query("gain_by_tercile", f"SELECT rung, fold, {_EDGE} AS tercile, count(*) AS n, round(avg(delta), 6) AS gain FROM (SELECT *, quantile_cont(vol, 1.0 / 3) OVER (PARTITION BY rung, fold) AS lo, quantile_cont(vol, 2.0 / 3) OVER (PARTITION BY rung, fold) AS hi FROM gains) GROUP BY ALL")
def gain_by_tercile(spark, d):
    return _by_tercile(gains(spark, d), ["rung", "fold"]).groupBy("rung", "fold", "tercile").agg(F.count("*").alias("n"), r(F.avg("delta"), "gain"))


@query("weekly_gain_by_tercile", f"SELECT {_EDGE} AS tercile, count(*) AS n, round(avg(delta), 6) AS gain FROM (SELECT *, quantile_cont(vol, 1.0 / 3) OVER () AS lo, quantile_cont(vol, 2.0 / 3) OVER () AS hi FROM (SELECT k, week, avg(delta) AS delta, avg(vol) AS vol FROM gains GROUP BY k, week)) GROUP BY ALL")
def weekly_gain_by_tercile(spark, d):
    weekly = gains(spark, d).groupBy("k", "week").agg(F.avg("delta").alias("delta"), F.avg("vol").alias("vol")).withColumn("one", F.lit(1))
    return _by_tercile(weekly, ["one"]).groupBy("tercile").agg(F.count("*").alias("n"), r(F.avg("delta"), "gain"))


@query("gain_by_horizon", "SELECT a.rung, a.horizon, round(avg(a.pinball - b.pinball), 7) AS gain FROM scored a JOIN scored b USING (k, rung, fold, seed, window_id, horizon) WHERE a.model = 'tuned' AND b.model = 'base' GROUP BY a.rung, a.horizon")
def gain_by_horizon(spark, d):
    p = paired(scored(spark, d), ["k", *CELL, "window", "horizon"], "pinball")
    return p.groupBy("rung", "horizon").agg(r(F.avg("delta"), "gain", 7))


@query("width_ratio", "SELECT rung, fold, round(avg(interval_width) FILTER (model = 'tuned') / avg(interval_width) FILTER (model = 'base'), 6) AS width_ratio FROM scored GROUP BY rung, fold")
def width_ratio(spark, d):
    m = lambda n: F.avg(F.when(F.col("model") == n, F.col("interval_width")))
    return scored(spark, d).groupBy("rung", "fold").agg(r(ratio(m("tuned"), m("base")), "width_ratio"))


@query("run_ranking", "SELECT rung, seed, round(wql, 6) AS wql, round(wql - base, 6) AS vs_base, round(wql - control, 6) AS vs_control, round(win, 6) AS win_rate, row_number() OVER (ORDER BY round(wql, 9), rung, seed) AS rank FROM (SELECT rung, seed, avg(wql) FILTER (model = 'tuned') AS wql, avg(wql) FILTER (model = 'base') AS base FROM runwql GROUP BY rung, seed) JOIN (SELECT seed, avg(wql) AS control FROM runwql WHERE rung = 60 AND model = 'tuned' GROUP BY seed) USING (seed) JOIN (SELECT a.rung, a.seed, avg(CAST(a.wql < b.wql AS INT)) AS win FROM wfold a JOIN wfold b USING (rung, fold, seed, k, window_id) WHERE a.model = 'tuned' AND b.model = 'base' GROUP BY a.rung, a.seed) USING (rung, seed)")
def run_ranking(spark, d):
    runs = run_wql(spark, d)
    m = lambda n: F.avg(F.when(F.col("model") == n, F.col("wql")))
    own = runs.groupBy("rung", "seed").agg(m("tuned").alias("wql"), m("base").alias("base"))
    control = own.where("rung = 60").select("seed", F.col("wql").alias("control"))
    w = window_scores(spark, d)
    win = paired(w, [*CELL, "k", "window"]).groupBy("rung", "seed").agg(F.avg((F.col("delta") < 0).cast("int")).alias("win"))
    out = own.join(control, "seed").join(win, ["rung", "seed"])
    place = F.row_number().over(Window.orderBy(F.round("wql", 9), "rung", "seed")).cast("long")  # one row a run
    return out.select("rung", "seed", r("wql"), r(F.col("wql") - F.col("base"), "vs_base"), r(F.col("wql") - F.col("control"), "vs_control"), r("win", "win_rate"), place.alias("rank"))


@query("adaptation_gain", "SELECT rung, fold, k, window_id AS \"window\", round(delta, 6) AS gain FROM deltas")
def adaptation_gain(spark, d):
    return deltas(spark, d).select(*_KEYS, r("delta", "gain"))


@query("model_filter", "SELECT rung, model, count(*) AS n_rows FROM preds WHERE model = 'tuned' OR rung = 20 GROUP BY rung, model")
def model_filter(spark, d):
    return predictions(spark, d).where("model = 'tuned' or rung = 20").groupBy("rung", "model").agg(F.count("*").alias("n_rows"))


@query("paired_predictions", "SELECT rung, fold, count(*) AS n, round(avg(abs(a.prediction - b.prediction)), 6) AS gap FROM preds a JOIN preds b USING (k, rung, fold, seed, window_id, horizon) WHERE a.model = 'tuned' AND b.model = 'base' AND a.actual = b.actual GROUP BY rung, fold")
def paired_predictions(spark, d):
    both = align.one_to_one(predictions(spark, d), ["k", *CELL, "window", "horizon", "actual"], "model", ("tuned", "base"), "prediction")
    return both.groupBy("rung", "fold").agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("tuned") - F.col("base"))), "gap"))


@query("event_conditioned_score", "SELECT model, rung, coalesce(is_event_day, 0) AS is_event_day, count(*) AS n, round(avg(pinball), 6) AS pinball FROM scored LEFT JOIN cal USING (date) GROUP BY ALL")
def event_conditioned_score(spark, d):
    c = F.broadcast(_calendar(spark, d).select("date", "is_event_day"))
    s = scored(spark, d).join(c, "date", "left").withColumn("is_event_day", F.coalesce("is_event_day", F.lit(0)))
    return s.groupBy("model", "rung", "is_event_day").agg(F.count("*").alias("n"), r(F.avg("pinball"), "pinball"))


@query("load_run_cells", "SELECT rung, fold, seed, count(*) AS n_rows FROM preds WHERE model = 'tuned' AND seed <> 2 GROUP BY rung, fold, seed")
def load_run_cells(spark, d):
    """Runs written in folders by rung, fold and seed, some ill-named, and read again: only the folders of well-named cells are opened."""

    def write():
        path = f"{sinks.shared(spark)}/runs-{uuid.uuid4().hex}"
        named = predictions(spark, d).withColumn("seed", F.when(F.col("seed") == 2, "2-broken").otherwise(F.col("seed").cast("string")))
        sinks.write_cells(named.select(*CELL, "model", "k", "window", "horizon", "prediction"), path, CELL)
        return path

    cells = sinks.read_cells(spark, once(spark, d, "runs", write), dict.fromkeys(CELL, "[0-9]+"))
    return cells.where("model = 'tuned'").groupBy(*(F.col(c).cast("int").alias(c) for c in CELL)).agg(F.count("*").alias("n_rows"))


@query("union_models", "SELECT model, count(*) AS n_rows, round(sum(prediction), 5) AS total FROM preds GROUP BY model")
def union_models(spark, d):
    p = predictions(spark, d)
    both = p.where("model = 'base'").drop("prediction").unionByName(p.where("model = 'tuned'"), allowMissingColumns=True)
    return both.groupBy("model").agg(F.count("*").alias("n_rows"), r(F.coalesce(F.sum("prediction"), F.lit(0.0)), "total", 5))


# aggregates ------------------------------------------------------------------------------------------------------------


@query("seed_aggregate", "SELECT rung, count(DISTINCT seed) AS n_seeds, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) FILTER (v < 0) AS n_negative FROM (SELECT rung, seed, avg(wql) FILTER (model = 'tuned') - avg(wql) FILTER (model = 'base') AS v FROM runwql GROUP BY rung, seed) GROUP BY rung")
def seed_aggregate(spark, d):
    m = lambda n: F.avg(F.when(F.col("model") == n, F.col("wql")))
    v = run_wql(spark, d).groupBy("rung", "seed").agg((m("tuned") - m("base")).alias("v"))
    return v.groupBy("rung").agg(F.count_distinct("seed").alias("n_seeds"), r(F.avg("v"), "mean"), r(F.stddev_samp("v"), "std"), F.count_if(F.col("v") < 0).alias("n_negative"))


@query("seed_mean_windows", "SELECT rung, fold, model, k, window_id AS \"window\", round(wql, 6) AS wql FROM seedmean")
def seed_mean_windows(spark, d):
    return seed_means(spark, d).select("rung", "fold", "model", "k", "window", r("wql"))


CTE["byfold"] = "SELECT rung, fold, avg(wql) AS wql FROM runwql WHERE model = 'tuned' GROUP BY rung, fold"
_PIV = ", ".join(f"max(wql) FILTER (fold = {y}) AS f{y}" for y in YEARS)


def _by_fold(spark, d):
    return run_wql(spark, d).where("model = 'tuned'").groupBy("rung", "fold").agg(F.avg("wql").alias("wql"))


@query("wql_pivot", f"SELECT rung, {', '.join(f'round(f{y}, 6) AS f{y}' for y in YEARS)}, round(m, 6) AS mean FROM (SELECT rung, {_PIV}, avg(wql) AS m FROM byfold GROUP BY rung)")
def wql_pivot(spark, d):
    b = _by_fold(spark, d)
    wide = b.groupBy("rung").pivot("fold", list(YEARS)).agg(F.first("wql")).join(b.groupBy("rung").agg(F.avg("wql").alias("mean")), "rung")
    return wide.select("rung", *(r(F.col(str(y)), f"f{y}") for y in YEARS), r("mean"))


@query("pct_vs_control", "SELECT rung, fold, round(100 * (b.wql / c.wql - 1), 5) AS pct FROM byfold b JOIN (SELECT fold, wql FROM byfold WHERE rung = 60) c USING (fold)")
def pct_vs_control(spark, d):
    b = _by_fold(spark, d)
    c = b.where("rung = 60").select("fold", F.col("wql").alias("c"))
    return b.join(c, "fold").select("rung", "fold", r(100 * (ratio(F.col("wql"), F.col("c")) - 1), "pct", 5))


@query("best_rung", "SELECT CAST(arg_min(rung, m) AS INT) AS best_rung, round(min(m), 6) AS mean FROM (SELECT rung, avg(wql) AS m FROM byfold WHERE rung <> 60 GROUP BY rung)")
def best_rung(spark, d):
    m = _by_fold(spark, d).where("rung <> 60").groupBy("rung").agg(F.avg("wql").alias("m"))
    return m.agg(F.min_by("rung", "m").alias("best_rung"), r(F.min("m"), "mean"))


@query("wql_by_horizon", f"SELECT horizon, {', '.join(f'round(avg(w) FILTER (rung = {n}), 6) AS r{n}' for n in RUNGS)} FROM (SELECT rung, fold, horizon, 2 * avg(pinball) / avg(abs(actual)) AS w FROM scored WHERE model = 'tuned' GROUP BY ALL) GROUP BY horizon")
def wql_by_horizon(spark, d):
    s = scored(spark, d).where("model = 'tuned'").groupBy("rung", "fold", "horizon").agg((2 * ratio(F.avg("pinball"), F.avg(F.abs("actual")))).alias("w"))
    wide = s.groupBy("horizon").pivot("rung", list(RUNGS)).agg(F.avg("w"))
    return wide.select("horizon", *(r(F.col(str(n)), f"r{n}") for n in RUNGS))


@query("calibration_curve", f"SELECT model, CAST({_L}[i] AS DOUBLE) AS level, round(avg(CAST(actual <= q[i] AS INT)), 6) AS share FROM preds CROSS JOIN (SELECT unnest(range(1, 22)) AS i) GROUP BY model, i")
def calibration_curve(spark, d):
    e = predictions(spark, d).select("model", "actual", F.posexplode("q").alias("i", "x"))
    at = F.element_at(F.array(*map(F.lit, score.LEVELS)), F.col("i") + 1)
    return e.groupBy("model", "i").agg(r(F.avg((F.col("actual") <= F.col("x")).cast("int")), "share")).select("model", at.alias("level"), "share")


@query("score_by_half", "SELECT rung, fold, model, CASE WHEN window_id < n / 2 THEN 'first' ELSE 'second' END AS half, round(avg(wql), 6) AS wql FROM (SELECT *, max(window_id) OVER (PARTITION BY rung, fold) + 1 AS n FROM seedmean) GROUP BY ALL")
def score_by_half(spark, d):
    n = F.max("window").over(Window.partitionBy("rung", "fold")) + 1
    s = seed_means(spark, d).withColumn("half", F.when(F.col("window") < n / 2, "first").otherwise("second"))
    return s.groupBy("rung", "fold", "model", "half").agg(r(F.avg("wql"), "wql"))


@query("spearman", "SELECT k, round(corr(a, b), 6) AS rho FROM (SELECT k, rank() OVER (PARTITION BY k ORDER BY vol) + (count(*) OVER (PARTITION BY k, vol) - 1) / 2.0 AS a, rank() OVER (PARTITION BY k ORDER BY delta) + (count(*) OVER (PARTITION BY k, delta) - 1) / 2.0 AS b FROM gains WHERE rung = 20) GROUP BY k")
def spearman(spark, d):
    g = gains(spark, d).where("rung = 20").select("k", rolling.average_rank("vol", ["k"]).alias("a"), rolling.average_rank("delta", ["k"]).alias("b"))
    return g.groupBy("k").agg(r(F.corr("a", "b"), "rho"))


@query("marginal_effect", "SELECT rung, fold, k, window_id AS \"window\", round(wql - lag(wql) OVER (PARTITION BY fold, k, window_id ORDER BY rung), 6) AS effect FROM seedmean WHERE model = 'tuned'")
def marginal_effect(spark, d):
    w = Window.partitionBy("fold", "k", "window").orderBy("rung")
    return seed_means(spark, d).where("model = 'tuned'").select(*_KEYS, r(F.col("wql") - F.lag("wql").over(w), "effect"))


for _name, _sort in (("top_improvements", "ASC"), ("top_regressions", "DESC")):

    @query(_name, f"SELECT rung, fold, k, window_id AS \"window\", round(delta, 6) AS delta FROM deltas ORDER BY round(delta, 9) {_sort}, rung, fold, k, window_id LIMIT 10")
    def _top(spark, d, sort=_sort):
        x = F.round("delta", 9)
        return deltas(spark, d).orderBy(x.asc() if sort == "ASC" else x.desc(), *_KEYS).limit(10).select(*_KEYS, r("delta"))


# bootstraps ------------------------------------------------------------------------------------------------------------

DRAWS = 3000


@query("paired_delta", "SELECT rung, fold, count(*) AS n, round(avg(delta), 6) AS mean, round(avg(CAST(delta < 0 AS INT)), 6) AS win_share FROM deltas GROUP BY rung, fold")
def paired_delta(spark, d):
    return deltas(spark, d).groupBy("rung", "fold").agg(F.count("*").alias("n"), r(F.avg("delta"), "mean"), r(F.avg((F.col("delta") < 0).cast("int")), "win_share"))


def _draw_sql(frame, groups, block=1, order="fold, k, window_id"):
    name = " || '/' || ".join(f"CAST({g} AS VARCHAR)" for g in groups)
    g = ", ".join(groups)
    return f"""SELECT {g}, draw, avg(v.delta) AS mean FROM (SELECT {g}, draw, (CAST('0x' || substr(md5('7|' || {name} || '|' || draw || '|' || i // {block}), 1, 8) AS BIGINT) % n + i % {block}) % n AS j FROM (SELECT {g}, row_number() OVER (PARTITION BY {g} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {g}) AS n FROM {frame}) CROSS JOIN (SELECT unnest(range(0, {DRAWS})) AS draw)) JOIN (SELECT {g}, delta, row_number() OVER (PARTITION BY {g} ORDER BY {order}) - 1 AS j FROM {frame}) v USING ({g}, j) GROUP BY {g}, draw"""


def _ci_sql(inner, groups):
    g = ", ".join(groups)
    return f"SELECT {g}, round(quantile_cont(mean, 0.025), 6) AS ci_lo, round(quantile_cont(mean, 0.975), 6) AS ci_hi FROM ({inner}) GROUP BY {g}"


_ORDER = ["fold", "k", "window"]


def _ci(df, keys, value="delta", order=None, **more):
    return resample.interval(resample.draws(df, keys, value, order or _ORDER, DRAWS, **more), keys).select(*keys, r("ci_lo"), r("ci_hi"))


@query("bootstrap_ci", _ci_sql(_draw_sql("deltas", ["rung", "fold"]), ["rung", "fold"]))
def bootstrap_ci(spark, d):
    return _ci(deltas(spark, d), ["rung", "fold"])


@query("block_bootstrap_ci", _ci_sql(_draw_sql("deltas", ["rung", "fold"], 5), ["rung", "fold"]))
def block_bootstrap_ci(spark, d):
    return _ci(deltas(spark, d), ["rung", "fold"], block=5)


@query("stratified_block_ci", _ci_sql(f"SELECT rung, draw, avg(mean) AS mean FROM ({_draw_sql('deltas', ['rung', 'fold'], 5)}) GROUP BY rung, draw", ["rung"]))
def stratified_block_ci(spark, d):
    return _ci(deltas(spark, d), ["rung"], block=5, within=["fold"])


_VERDICT = "CASE WHEN ci_hi < 0 THEN 'better' WHEN ci_lo > 0 THEN 'worse' ELSE 'open' END"


def _judged(df):
    ci = _ci(df, ["rung"])
    mean = df.groupBy("rung").agg(F.count("*").alias("n"), r(F.avg("delta"), "mean"))
    return mean.join(ci, "rung").withColumn("verdict", F.when(F.col("ci_hi") < 0, "better").when(F.col("ci_lo") > 0, "worse").otherwise("open"))


for _name, _cte, _make in (("pooled_delta", "deltas", deltas), ("delta_vs_control", "versus", versus_control)):

    @query(_name, f"SELECT rung, n, mean, ci_lo, ci_hi, {_VERDICT} AS verdict FROM (SELECT rung, count(*) AS n, round(avg(delta), 6) AS mean FROM {_cte} GROUP BY rung) JOIN ({_ci_sql(_draw_sql(_cte, ['rung']), ['rung'])}) USING (rung)")
    def _pooled(spark, d, make=_make):
        return _judged(make(spark, d))


# importance ------------------------------------------------------------------------------------------------------------

#: A forecast that reads covariates: the sixty-session deviation, scaled by the last values of these.
FEATURES, REPEATS, CONTEXT, YEAR = ("volume_z", "momentum_21", "dist_ma50", "overnight_gap"), 2, 20, 1998


def _sigma(last) -> F.Column:
    return F.col("s60") * reduce(lambda a, b: a + b, (0.15 * F.least(F.abs(F.coalesce(last(f), F.lit(0.0))), F.lit(4.0)) for f in FEATURES), F.lit(0.5))


def _sigma_sql(last) -> str:
    return "s60 * (0.5 + " + " + ".join(f"0.15 * least(abs(coalesce({last(f)}, 0.0)), 4.0)" for f in FEATURES) + ")"


CTE["ctx"] = "SELECT o.k, o.window_id, o.origin, x.s60, " + ", ".join(f"x.{f}" for f in FEATURES) + f" FROM org o JOIN (SELECT k, idx, stddev_samp(y) {_frame(60)} AS s60, {', '.join(FEATURES)} FROM feats) x ON x.k = o.k AND x.idx = o.origin WHERE o.fold = {YEAR}"
CTE["fr"] = "SELECT f.f AS feature, r.r AS repeat FROM (SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATURES) + f"]) AS f) f CROSS JOIN (SELECT CAST(unnest(range(0, {REPEATS})) AS INT) AS r) r"
CTE["dnr"] = "SELECT k, feature, repeat, window_id, coalesce(lead(window_id) OVER w, first_value(window_id) OVER w) AS donor FROM (SELECT k, feature, repeat, window_id, md5('7|' || k || '|' || feature || '|' || repeat || '|' || window_id) AS h FROM ctx CROSS JOIN fr) WINDOW w AS (PARTITION BY k, feature, repeat ORDER BY h, window_id)"
_LOSS = f"list_avg([greatest({_L}[i] * (t.actual - sg * {_Z}[i]), ({_L}[i] - 1) * (t.actual - sg * {_Z}[i])) FOR i IN range(1, 22)])"
CTE["permuted"] = f"SELECT c.k, n.feature, n.repeat, c.window_id, n.donor, c.origin, {_sigma_sql(lambda f: f'c.{f}')} AS s0, {_sigma_sql(lambda f: f'''CASE WHEN n.feature = '{f}' THEN e.{f} ELSE c.{f} END''')} AS s1 FROM ctx c JOIN dnr n ON n.k = c.k AND n.window_id = c.window_id JOIN ctx e ON e.k = c.k AND e.window_id = n.donor".replace("s60 *", "c.s60 *")
CTE["imp"] = f"SELECT p.k, feature, repeat, p.window_id, min(t.forecast_origin) AS forecast_origin, 2 * avg({_LOSS.replace('sg', 's0')}) / avg(abs(t.actual)) AS baseline_wql, 2 * avg({_LOSS.replace('sg', 's1')}) / avg(abs(t.actual)) AS permuted_wql FROM permuted p JOIN tgt t ON t.k = p.k AND t.origin = p.origin AND t.fold = {YEAR} GROUP BY p.k, feature, repeat, p.window_id"


def contexts(spark, d):
    """k, window, origin, s60 and the context arrays of the features."""
    o = windows.origins(folded(spark, d), ["k", "fold"], HORIZON, STRIDE).where(F.col("fold") == YEAR).drop("fold")
    x = features(spark, d).withColumn("s60", F.stddev_samp("y").over(by("k").rowsBetween(-59, 0)))
    c = windows.context(x, ["k"], list(FEATURES), CONTEXT).select("k", F.col("idx").alias("origin"), "s60", *(F.col(f"{f}_context").alias(f) for f in FEATURES))
    return o.join(c, ["k", "origin"])


def feature_donors(spark, d):
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(i).alias("repeat")) for f in FEATURES for i in range(REPEATS))))
    w = contexts(spark, d).select("k", "window", each.alias("x")).select("k", "window", "x.*")
    return resample.donors(w, ["k", "feature", "repeat"])


def swapped(spark, d):
    """For each feature, repeat and window the contexts with that feature's array taken from its donor, tail-aligned; the others stay."""
    c = contexts(spark, d)
    donor = c.select("k", F.col("window").alias("donor"), *(F.col(f).alias(f"donor_{f}") for f in FEATURES))
    both = feature_donors(spark, d).join(c, ["k", "window"]).join(donor, ["k", "donor"])
    new = {f"new_{f}": F.when(F.col("feature") == f, resample.tail_aligned(F.col(f"donor_{f}"), F.col(f))).otherwise(F.col(f)) for f in FEATURES}
    return both.withColumns(new)


def importances(spark, d):
    last = lambda pre: (lambda f: F.try_element_at(F.col(f"{pre}{f}"), F.lit(-1)))
    s = swapped(spark, d).withColumn("before", _sigma(last(""))).withColumn("after", _sigma(last("new_")))
    t = targets(spark, d).where(F.col("fold") == YEAR).select("k", "origin", "actual", "forecast_origin")
    rows = s.select("k", "feature", "repeat", "window", "origin", "before", "after").join(t, ["k", "origin"])
    wq = lambda c: 2 * ratio(F.avg(loss(score.LEVELS, score.gaussian_quantiles(F.col(c)), F.col("actual"))), F.avg(F.abs("actual")))
    out = rows.groupBy("k", "feature", "repeat", "window").agg(F.min("forecast_origin").alias("forecast_origin"), wq("before").alias("baseline_wql"), wq("after").alias("permuted_wql"))
    return out.withColumn("delta", F.col("permuted_wql") - F.col("baseline_wql"))


@query("draw_donors", "SELECT k, feature, repeat, window_id AS \"window\", donor FROM dnr")
def draw_donors(spark, d):
    return feature_donors(spark, d).select("k", "feature", "repeat", "window", "donor")


@query("swap_feature", "SELECT k, feature, repeat, window_id AS \"window\", donor, round(last_value, 5) AS last_value FROM (SELECT n.*, CASE n.feature " + " ".join(f"WHEN '{f}' THEN e.{f}" for f in FEATURES) + " END AS last_value FROM dnr n JOIN ctx e ON e.k = n.k AND e.window_id = n.donor)")
def swap_feature(spark, d):
    last = F.coalesce(*(F.when(F.col("feature") == f, F.try_element_at(F.col(f"new_{f}"), F.lit(-1))) for f in FEATURES))
    return swapped(spark, d).select("k", "feature", "repeat", "window", "donor", r(last, "last_value", 5))


@query("importance_by_window", "SELECT k, feature, repeat, window_id AS \"window\", round(baseline_wql, 5) AS baseline_wql, round(permuted_wql, 5) AS permuted_wql FROM imp")
def importance_by_window(spark, d):
    return importances(spark, d).select("k", "feature", "repeat", "window", r("baseline_wql", places=5), r("permuted_wql", places=5))


@query("importance_summary", "SELECT feature, round(avg(dl), 5) AS mean, round(stddev_samp(dl), 5) AS std, round(avg(CAST(dl > 0 AS INT)), 4) AS share_positive, round(avg(dl / baseline_wql), 5) AS relative FROM (SELECT *, permuted_wql - baseline_wql AS dl FROM imp) GROUP BY feature")
def importance_summary(spark, d):
    return importances(spark, d).groupBy("feature").agg(r(F.avg("delta"), "mean", 5), r(F.stddev_samp("delta"), "std", 5), r(F.avg((F.col("delta") > 0).cast("int")), "share_positive", 4), r(F.avg(ratio(F.col("delta"), F.col("baseline_wql"))), "relative", 5))


@query("importance_heatmap", "SELECT forecast_origin, " + ", ".join(f"round(avg(permuted_wql - baseline_wql) FILTER (feature = '{f}'), 5) AS {f}" for f in FEATURES) + " FROM imp GROUP BY forecast_origin")
def importance_heatmap(spark, d):
    wide = importances(spark, d).groupBy("forecast_origin").pivot("feature", list(FEATURES)).agg(F.avg("delta"))
    return wide.select("forecast_origin", *(r(f, places=5) for f in FEATURES))


CTE["impwin"] = "SELECT feature, k, window_id, avg(permuted_wql - baseline_wql) AS delta FROM imp GROUP BY feature, k, window_id"


def _window_importance(spark, d):
    return importances(spark, d).groupBy("feature", "k", "window").agg(F.avg("delta").alias("delta"))


@query("importance_ci", _ci_sql(_draw_sql("impwin", ["feature"], order="k, window_id"), ["feature"]).replace("0.025), 6", "0.025), 4").replace("0.975), 6", "0.975), 4"))
def importance_ci(spark, d):
    ci = resample.interval(resample.draws(_window_importance(spark, d), ["feature"], "delta", ["k", "window"], DRAWS), ["feature"])
    return ci.select("feature", r("ci_lo", places=4), r("ci_hi", places=4))


@query("importance_profile_corr", "SELECT a.k AS k, round(corr(a.delta, b.delta), 5) AS corr FROM impwin a JOIN impwin b USING (feature, window_id) WHERE b.k = 'AF' AND a.k <> 'AF' GROUP BY a.k")
def importance_profile_corr(spark, d):
    w = _window_importance(spark, d)
    b = w.where("k = 'AF'").select("feature", "window", F.col("delta").alias("b"))
    return w.where("k <> 'AF'").join(b, ["feature", "window"]).groupBy("k").agg(r(F.corr("delta", "b"), "corr", 5))


@query("ranking", "SELECT feature, round(m, 5) AS mean, row_number() OVER (ORDER BY round(m, 9) DESC, feature) AS rank FROM (SELECT feature, avg(delta) AS m FROM impwin GROUP BY feature)")
def ranking(spark, d):
    m = _window_importance(spark, d).groupBy("feature").agg(F.avg("delta").alias("m"))
    return m.select("feature", r("m", "mean", 5), F.row_number().over(Window.orderBy(F.round("m", 9).desc(), "feature")).cast("long").alias("rank"))  # one row a feature


@query("forecast_udf", f"SELECT o.k, o.fold, o.window_id AS \"window\", h.h AS horizon, round(s.s60 * {_Z}[3], 6) AS q10, round(s.s60 * {_Z}[19], 6) AS q90 FROM org o JOIN sigmas s ON s.k = o.k AND s.origin = o.origin CROSS JOIN (SELECT CAST(unnest(range(1, {HORIZON + 1})) AS INT) AS h) h")
def forecast_udf(spark, d):
    o = windows.origins(folded(spark, d), ["k", "fold"], HORIZON, STRIDE)
    c = windows.context(rets(spark, d), ["k"], ["y"], 60).select("k", F.col("idx").alias("origin"), "y_context").join(o, ["k", "origin"])
    q = forecast(c, ["k", "fold", "window"], "y_context", HORIZON)
    return q.select("k", "fold", "window", "horizon", r(score.level("q", 0.1), "q10"), r(score.level("q", 0.9), "q90"))

