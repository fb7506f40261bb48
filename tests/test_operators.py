"""Literal vectors, metamorphic and plan tests of the operators."""

import hashlib
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import scalars
from tidemark.operators import align, calendar, resample, rolling, score, windows
from tidemark.plans import audit, base, market
from tidemark.sources import landed


def D(s):
    return date.fromisoformat(s)


@pytest.fixture(scope="module")
def days(spark):
    return calendar.calendar_spine(spark, "2005-12-01", "2026-12-31").cache()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("cutover,pairs", [(None, {"2026-09-02": "2026-09-04", "2026-09-03": "2026-09-08", "2026-09-04": "2026-09-09", "2024-10-11": "2024-10-16", "2024-11-27": "2024-12-02"}), ("2019-06-21", {"2019-05-24": "2019-05-29", "2026-09-04": "2026-09-08"})])
def test_publication_date(spark, days, cutover, pairs):
    refs = spark.createDataFrame([(D(k),) for k in pairs], "ref_date date")
    out = align.publication_date(refs, calendar.day_map(days, calendar.business_days(days), "date"), calendar.session_day_map(days), cutover=cutover)
    assert {str(r.ref_date): str(r.published) for r in out.collect()} == pairs


def test_first_close_after(spark, days):
    at = [datetime(2024, 11, 29, 17), datetime(2024, 11, 29, 18), None, datetime(2024, 11, 29, 17, 30)]
    e = spark.createDataFrame([(i, t, D("2024-11-29")) for i, t in enumerate(at)], "id int, accepted timestamp, filed date")
    out = align.first_close_after(e, calendar.session_day_map(days))
    assert [(str(a), p) for _, a, p in rows(out.select("id", "available", "phase"), "id")] == [("2024-11-29", "pre"), ("2024-12-02", "post"), ("2024-12-02", "post"), ("2024-11-29", "pre")]


def test_asof_shared_availability(spark):
    b = spark.createDataFrame([("q", D("2006-04-17"))], "k string, date date")
    o = spark.createDataFrame([("q", D("2006-04-12"), D("2006-04-17"), 4.91, None), ("q", D("2006-04-13"), D("2006-04-17"), 4.96, 1.0)], "k string, ref date, avail date, v double, w double")
    assert rows(align.asof_join(b, o, ["v", "w"], ["k"], ties=["ref"]), "date") == [("q", D("2006-04-17"), 4.96, 1.0)]


def test_vintages(spark):
    v = spark.createDataFrame([("c", D("2023-01-01"), D("2024-02-13"), 100.0, 1), ("c", D("2024-01-01"), D("2024-02-13"), 105.0, 2), ("c", D("2024-01-01"), D("2024-02-20"), 106.0, 3)], "k string, ref_month date, realtime_start date, value double, seq int")
    out = rows(align.vintage_as_known(v, ["k"]).select("realtime_start", "is_new_print", F.round("yoy", 9)), "realtime_start")
    assert out == [(D("2024-02-13"), True, 0.05), (D("2024-02-20"), False, 0.06)]


def test_merge_cache(spark):
    old = spark.createDataFrame([(1, 1), (2, 2)], "d int, v int")
    new = spark.createDataFrame([(2, None), (3, 3)], "d int, v int")
    assert rows(align.merge_cache(old, new, ["d"], ["v"]), "d") == [(1, 1), (2, 2), (3, 3)]


def test_text_dates(spark):
    t = spark.createDataFrame([("June 28, 2007 For immediate release", D("2007-06-18")), ("none", D("2007-06-18"))], "t string, d date")
    assert [r[0] for r in t.select(scalars.printed_date(F.col("t"), F.col("d"))).collect()] == [D("2007-06-28"), D("2007-06-18")]
    heads = {"July 31-August 1  Meeting - 2012": "2012-08-01", "Jan/Feb 31-1 Meeting - 2011": "2011-02-01", "January 30-31 Meeting - 2007": "2007-01-31", "December 16 Meeting - 2008": "2008-12-16", "Meeting minutes": None}
    h = spark.createDataFrame([(x,) for x in heads], "t string")
    assert {r[0]: r[1] and str(r[1]) for r in h.select("t", scalars.heading_date(F.col("t"))).collect()} == heads


def test_date_range(spark):
    b = spark.createDataFrame([(D(f"2026-01-{i:02d}"),) for i in range(1, 12)], "date date")
    assert audit.in_range(b, "date", "2026-01-05", "2026-01-09").count() == 5
    with pytest.raises(ValueError):
        audit.in_range(b, "date", "2026-01-09", "2026-01-05")


def test_select_columns():
    assert market.select_columns("target") == []
    assert "volume_z" not in market.select_columns("core", groups=["price"], without=["volume_z"])
    with pytest.raises(ValueError):
        market.select_columns(only=["y"])


def test_sessions_ahead_and_gap(spark, days):
    s = [r.session_date for r in calendar.trading_sessions(days).where("session_date > '2026-09-04'").orderBy("session_date").limit(5).collect()]
    assert list(map(str, s)) == ["2026-09-08", "2026-09-09", "2026-09-10", "2026-09-11", "2026-09-14"]
    o = spark.createDataFrame([("k", 1)], "k string, idx long")
    have = spark.createDataFrame([("k", 2, 1.0), ("k", 4, 1.0)], "k string, idx long, v double")
    assert rows(align.horizon_covered(o, have, ["k"], 2, ["v"]), "k") == [("k", 1, False)]


def _windowed(spark, values):
    s = spark.createDataFrame([("k", i + 1, D("2020-01-01"), float(v), i % 3) for i, v in enumerate(values)], "k string, idx long, date date, y double, event int")
    c = windows.context(s, ["k"], ["y"], 4).where("idx = 8").select("y_context")
    f = windows.future(s, ["k"], ["event"], 2).where("idx = 8").select("event_future")
    return c.first()[0], f.first()[0]


def test_no_leak(spark):
    a = _windowed(spark, range(12))
    assert a == _windowed(spark, [*range(8), 99, 98, 97, 96]) == ([4.0, 5.0, 6.0, 7.0], [2, 0])


def test_future_rejects_missing(spark):
    s = spark.createDataFrame([("k", 1, 1), ("k", 2, 1), ("k", 3, None)], "k string, idx long, e int")
    assert [r.idx for r in windows.future(s, ["k"], ["e"], 1).collect()] == [1]


def test_baseline_and_wql(spark):
    q = [s * 0.015 for s in score.Z]
    p = spark.createDataFrame([("m", 0, h, a, q, 0.0) for h, a in ((1, 0.01), (2, -0.02))], "model string, window int, horizon int, actual double, q array<double>, prediction double")
    loss = np.mean([[max(t * (a - x), (t - 1) * (a - x)) for t, x in zip(score.LEVELS, q)] for a in (0.01, -0.02)])
    got = score.window_wql(p, ["model"], ["model", "window"]).first().wql
    assert got == pytest.approx(2 * loss / 0.015)
    m = {r.horizon: r for r in score.metrics(score.with_errors(p), ["model"]).collect()}
    assert set(m) == {"1", "2", "overall"} and m["overall"].wql == pytest.approx(got) and m["overall"].bias == pytest.approx(0.005)


@pytest.mark.parametrize("n", [2, 3, 7, 50])
def test_donors_are_one_cycle(spark, n):
    w = spark.createDataFrame([("f", i) for i in range(n)], "feature string, window long")
    to = {r.window: r.donor for r in resample.donors(w, ["feature"]).collect()}
    at, seen = 0, set()
    while at not in seen:
        seen.add(at)
        at = to[at]
    assert len(seen) == n and all(k != v for k, v in to.items())


def test_tail_aligned(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 0.0]), ([1.0], [0.0, 0.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in d.select(resample.tail_aligned(F.col("a"), F.col("b"))).collect()] == [[2.0, 3.0], [None, None, 1.0]]


def test_rolling_against_pandas(spark):
    rng = np.random.default_rng(3)
    x = pd.Series(np.where(rng.random(300) < 0.2, np.nan, rng.normal(size=300)))
    s = landed.doubles_clean(spark.createDataFrame(pd.DataFrame({"k": "a", "date": range(300), "x": x})))
    w = rolling.by("k")
    got = s.select("date", rolling.ewm("x", w, 3).alias("e"), rolling.rolling(F.stddev_samp, "x", w, 20, 15).alias("s")).orderBy("date").toPandas()
    np.testing.assert_allclose(got.e.astype(float), x.ewm(halflife=3).mean(), rtol=1e-9)
    np.testing.assert_allclose(got.s.astype(float), x.rolling(20, min_periods=15).std(), rtol=1e-9)


def test_landed_edges(spark):
    e = spark.createDataFrame([], "k string, date date, seq int, v double")
    assert landed.keep_last(e, ["k", "date"], "seq").count() == 0
    y = spark.createDataFrame([(2020, 2, 30, 1.0, 1), (2020, 2, 28, 1.0, 1), (2020, 2, 28, 2.0, 2), (None, 1, 1, 3.0, 1)], "year int, month int, day int, value double, seq int")
    assert rows(landed.from_ymd(y, "seq"), "date") == [(D("2020-02-28"), 2.0)]
    with pytest.raises(ValueError):
        landed.inventory({"a": (None, "date", True)})


SMALL = "/root/testdata/sf0.001"
CHECKED = ["bars_daily", "asof_multi_column", "window_mean_join", "publication_date", "first_close_after", "vintage_as_known", "event_calendar", "feature_table", "metrics_grouping_sets", "block_bootstrap_ci", "importance_by_window", "sentences", "price_validation", "entity_flags", "changed_sources", "timeline_tone", "page_text", "table_fingerprint", "session_schedule", "daily_features", "period_rules", "rate_recompute", "readiness_conditions", "statement_links", "contract_audit", "changed_columns"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    b = con.sql(catalog.ORACLE[name]).df()
    a = catalog.QUERIES[name](spark, SMALL).toPandas()[list(b.columns)]
    plain = [sorted(tuple("~" if pd.isna(v) else f"{v:.9g}" if isinstance(v, (int, float, np.number)) else str(v)[:10] if isinstance(v, (date, pd.Timestamp)) else str(v) for v in r) for r in d.astype(object).itertuples(index=False)) for d in (a, b)]
    assert plain[0] == plain[1] and (len(a) or name in ("metrics_grouping_sets", "contract_audit", "paired_predictions"))


def test_series_windows_are_partitioned(spark):
    plan = base.rets(spark, SMALL).withColumns(rolling.price_features(rolling.by("k")))._jdf.queryExecution().executedPlan().toString()
    big = [x for x in plan.splitlines() if "SinglePartition" in x]
    assert len(big) <= 1  # the day calendar alone


def test_price_features_against_pandas(spark):
    rng = np.random.default_rng(3)
    n = 260
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    p = pd.DataFrame({"k": "a", "date": pd.date_range("2020-01-01", periods=n).date, "open": close * np.exp(rng.normal(0, 0.01, n)), "high": close * 1.02, "low": close * (0.99 - 0.02 * rng.random(n)), "close": close, "volume": np.where(rng.random(n) < 0.05, 0.0, rng.integers(1, 10**6, n).astype(float))})
    got = spark.createDataFrame(p).withColumns(rolling.price_features(rolling.by("k"))).orderBy("date").toPandas()
    lv = np.log(p.volume.replace(0, np.nan))
    want = {
        "overnight_gap": np.log(p.open / p.close.shift(1)),
        "range_vol": np.sqrt(np.log(p.high / p.low) ** 2 / (4 * np.log(2))).rolling(22, min_periods=15).mean(),
        "momentum_21": np.log(p.close / p.close.shift(21)),
        "momentum_63": np.log(p.close / p.close.shift(63)),
        "dist_ma50": np.log(p.close / p.close.rolling(50, min_periods=40).mean()),
        "dist_ma200": np.log(p.close / p.close.rolling(200, min_periods=150).mean()),
        "volume_z": (lv - lv.rolling(20, min_periods=15).mean()) / lv.rolling(20, min_periods=15).std(),
    }
    for name, x in want.items():
        np.testing.assert_allclose(got[name].astype(float), x, rtol=1e-8, atol=1e-12)


def test_sessions_on_known_days(spark):

    open_ = {r.session_date for r in calendar.trading_sessions(calendar.calendar_spine(spark, "1999-01-01", "2024-12-31")).select("session_date").collect()}
    business = {r.date for r in calendar.business_days(calendar.calendar_spine(spark, "2019-01-01", "2024-12-31")).select("date").collect()}
    day = date
    closed = [day(2022, 6, 20), day(2022, 4, 15), day(2024, 3, 29), day(2001, 4, 13), day(2000, 4, 21), day(2021, 12, 24), day(2023, 1, 2), day(2024, 6, 19), day(1999, 4, 2)]
    assert not open_ & set(closed)
    assert {day(2021, 12, 31), day(2021, 6, 18), day(2022, 4, 18), day(2024, 4, 1), day(1999, 12, 31)} <= open_
    assert day(2021, 6, 18) not in business and day(2021, 12, 31) not in business and day(2024, 3, 29) in business


def test_bootstrap_draws_against_python(spark):

    values = [float(v) for v in (3, 1, 4, 1, 5, 9, 2)]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    got = {r.draw: r["mean"] for r in resample.draws(df, ["k"], "v", ["i"], 40, block=3).collect()}
    pick = lambda d, i: values[(int(hashlib.md5(f"7|g|{d}|{i // 3}".encode()).hexdigest()[:8], 16) % 7 + i % 3) % 7]
    assert len(got) == 40 and all(abs(got[d] - sum(pick(d, i) for i in range(7)) / 7) < 1e-12 for d in got)
