"""Schedules, as-of joins by ranges, declared features, draws by place, rules, run contracts, digests and landed checks: each fault planted and seen."""

import hashlib
import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import align, calendar, contract, digest, features, resample, rules, text
from tidemark.operators.rolling import by
from tidemark.plans import audit, base, checks, evaluation
from tidemark.plans import features as plan
from tidemark.sources import landed, schedule, sinks

D = date.fromisoformat
SMALL = "/root/testdata/sf0.001"


# schedule


def test_known_days_by_schedule(spark):
    spine = calendar.calendar_spine(spark, "1995-12-01", "2001-12-31")
    told = schedule.latest(schedule.from_rules(spine).unionByName(schedule.closures(spark)))
    day = {r.day: r for r in told.collect()}
    assert day[D("1996-01-15")].is_open and day[D("1997-01-20")].is_open and not day[D("1998-01-19")].is_open
    assert all(not day[D(f"2001-09-{n}")].is_open and day[D(f"2001-09-{n}")].reason == "closure" for n in (11, 12, 13, 14)) and day[D("2001-09-17")].is_open
    assert day[D("2001-07-03")].close_ts == datetime(2001, 7, 3, 17) and day[D("2001-07-03")].reason == "early" and day[D("2001-07-04")].reason == "holiday"
    s = calendar.trading_sessions(told.withColumnRenamed("day", "date"))
    after = calendar.session_day_map(told.withColumnRenamed("day", "date")).where("date = '2001-09-10'").first()
    assert s.where("session_date between '2001-09-10' and '2001-09-17'").count() == 2 and after.next_after == D("2001-09-17")


def test_versions_and_refusals(spark, tmp_path):
    spine = calendar.calendar_spine(spark, "2024-01-01", "2024-01-31")
    schedule.write(schedule.from_rules(spine), str(tmp_path / "s"))
    schedule.write(schedule.closures(spark, ("2024-01-10",), 3), str(tmp_path / "s"))
    stored = schedule.read(spark, str(tmp_path / "s"))
    open_ = lambda **k: schedule.latest(stored, **k).where("day = '2024-01-10'").first().is_open
    assert not open_() and open_(as_of=2)
    assert schedule.within(schedule.latest(stored), D("2024-01-05"), D("2024-01-31")).count() == 27
    for first, last in (("2023-12-31", "2024-01-05"), ("2024-01-30", "2024-02-01")):
        with pytest.raises(ValueError, match="has"):
            schedule.within(schedule.latest(stored), D(first), D(last))
    with pytest.raises(ValueError, match="more than once"):
        schedule.within(stored, D("2024-01-01"), D("2024-01-31"))


def test_calendar_follows_the_data(spark, tmp_path):
    spark.createDataFrame([(datetime(2015, 3, 2),)], "l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(datetime(2016, 5, 31),)], "o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    got = base.days(spark, str(tmp_path)).agg(F.min("date"), F.max("date")).first()
    assert tuple(got) == (D("2015-02-01"), D("2016-10-31")) and base.last_day(spark, str(tmp_path)) == D("2016-10-31")


# as-of


def known_at(events, day, column):
    """The last value known on a day: of equal availability the latest reference, nulls left out."""
    past = [(e["avail"], e["ref"], e[column]) for e in events if e["avail"] <= day and e[column] is not None]
    return max(past)[2] if past else None


@pytest.mark.parametrize("span", [1, 7, 30, 10_000])
@pytest.mark.parametrize("told", [True, False])
def test_asof_in_ranges(spark, span, told):
    rng = random.Random(span)
    day = lambda n: D("2020-01-01") + timedelta(n)
    events = {k: [{"ref": day(t := rng.randrange(90)), "avail": day(t + rng.randrange(3)), "v": rng.choice([None, rng.random()]), "w": rng.choice([None, None, rng.random()])} for _ in range(n)] for k, n in (("a", 60), ("b", 4), ("c", 0))}
    rows = [(k, day(n)) for k in ("a", "b", "c", "d") for n in rng.sample(range(-10, 160), 40)]
    b = spark.createDataFrame(rows, "k string, date date")
    o = spark.createDataFrame([(k, e["ref"], e["avail"], e["v"], e["w"]) for k, es in events.items() for e in es], "k string, ref date, avail date, v double, w double")
    out = align.asof_join(b, o, ["v", "w"], ["k"], ties=["ref"], span=span, last=day(170) if told else None)
    got = {(r.k, r.date): (r.v, r.w) for r in out.collect()}
    assert len(got) == len(rows)
    for k, d in rows:
        assert got[k, d] == (known_at(events.get(k, []), d, "v"), known_at(events.get(k, []), d, "w"))


def test_long_series_takes_many_tasks(spark):
    days = spark.range(3000).select(F.lit("a").alias("k"), F.date_add(F.lit("2010-01-01"), F.col("id").cast("int")).alias("date"))
    out = align.asof_join(days, days.select("k", F.col("date").alias("avail"), F.rand(1).alias("v")), ["v"], ["k"], span=100, last=D("2019-01-01"))
    tree = out._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in tree.splitlines() if "Window" in x and "__side" in x]
    assert scan and all("__range" in x.split("], [")[1] for x in scan) and out.where("v is not null").count() == 3000


# declared features


def test_declared_twice_or_not_made(spark):
    with pytest.raises(ValueError, match="twice"):
        features.roles([features.Feature("a", "g", "past"), features.Feature("a", "g", "raw")])
    rows = spark.createDataFrame([("a", D("2024-01-02"), 1.0)], "k string, date date, y double")
    with pytest.raises(ValueError, match="neither"):
        features.table(rows, rows.select("date").distinct(), [features.Feature("lost", "g", "past")], by("k"), ["k", "date"])


def test_inputs_of_one_rule_share_a_scan(spark):
    days = calendar.calendar_spine(spark, "2024-01-01", "2024-03-31")
    m = calendar.session_day_map(days)
    sources = {n: days.select("date", F.dayofyear("date").cast("double").alias(n)) for n in ("a", "b", "c")}
    inputs = [features.Input("a1", "a", "a", features.ASOF, 1), features.Input("a0", "a", "a"), features.Input("b2", "b", "b", features.PUBLISHED), features.Input("cm", "c", "c", features.MEAN, 1), features.Input("x", "absent", "x")]
    s = calendar.trading_sessions(days).select(F.col("session_date").alias("date"))
    out = features.aligned(s, sources, inputs, calendar.day_map(days, calendar.business_days(days), "date"), m, D("2024-01-02"), D("2024-03-28"), "2019-06-21")
    got = {r.date: r for r in out.collect()}
    assert out.columns == ["date", "a1", "a0", "b2", "cm"]
    monday = got[D("2024-01-22")]  # Friday to Sunday came since the last session; what refers to the days of a long weekend is published after it
    assert (monday.a1, monday.a0, monday.cm) == (21.0, 22.0, (19 + 20 + 21) / 3) and got[D("2024-01-16")].b2 == 11.0 and got[D("2024-01-17")].b2 == 15.0 and got[D("2024-01-18")].b2 == 16.0
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("last(a0") == tree.count("last(b2") and sum("Window" in x and "__side" in x for x in tree.splitlines()) == 1


def test_features_against_pandas(spark):
    names = ["log_return_1d", "parkinson_vol_1d", "volatility_20d", "vxn_log_chg", "qqq_minus_spy", "d_dgs2_bp"]
    aligned = {"vxn_close", "spy_log_ret", "dgs2_lag1"}
    df = plan.daily(spark, SMALL).select("k", "date", "close", "high", "low", *names).toPandas().sort_values(["k", "date"])
    assert len(plan.NAMES) == 78 and set(plan.CORE) <= set(plan.NAMES) and aligned.isdisjoint({"k"})
    for _, p in df.groupby("k"):
        y = np.log(p.close / p.close.shift())
        np.testing.assert_allclose(p.log_return_1d.astype(float), y, rtol=1e-9)
        np.testing.assert_allclose(p.volatility_20d.astype(float), y.rolling(20).std(), rtol=1e-7)
        np.testing.assert_allclose(p.parkinson_vol_1d.astype(float), np.sqrt(np.log(p.high / p.low) ** 2 / (4 * math.log(2))), rtol=1e-9)


# draws


@pytest.mark.parametrize("block,chunk", [(1, 4), (3, 4), (5, 4096)])
def test_draws_of_any_size(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(resample, "CHUNK", chunk)
    values = {(k, f): [random.Random(f"{k}{f}").random() for _ in range(n)] for k, f, n in (("a", 1, 13), ("a", 2, 1), ("b", 1, 30))}
    rows = [(k, f, p, i, v) for (k, f), vs in values.items() for p, part in (("x", vs[: len(vs) // 3]), ("y", vs[len(vs) // 3 :])) for i, v in enumerate(part)]
    df = spark.createDataFrame(rows, "k string, f int, p string, i int, v double")
    got = {(r.k, r.f, r.draw): r["mean"] for r in resample.draws(df, ["k", "f"], "v", ["p", "i"], 20, block=block).collect()}

    def mean(k, f, d):
        vs = values[k, f]
        at = lambda i: (int(hashlib.md5(f"7|{k}/{f}|{d}|{i // block}".encode()).hexdigest()[:8], 16) % len(vs) + i % block) % len(vs)
        return sum(vs[at(i)] for i in range(len(vs))) / len(vs)

    assert len(got) == 60 and all(abs(m - mean(*k)) < 1e-12 for k, m in got.items())
    tree = resample.draws(df, ["k"], "v", ["f", "p", "i"], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert f"<= {chunk}" in tree and f"> {chunk}" in tree  # only groups of that size are arrays


# rules


def test_rules_by_period(spark):
    rows = [(k, D(f"20{y}-06-0{i}"), float(y - 20 + i) if k == "a" else None) for k in ("a", "b") for y in (20, 21, 22) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "k string, date date, x double")
    told = [("in 2021", "x", "mean", D("2021-01-01"), D("2021-12-31"), 2.9, 3.1, "FAIL"), ("all", "x", "mean", None, None, 0.0, 1.0, "WARN"), ("peak", "x", "year_of_max", None, None, 2022.0, 2022.0, "FAIL"), ("there", "x", "present_share", None, D("2020-12-31"), 1.0, 1.0, "FAIL"), ("yearly", "x", "sum_a_year", None, None, 8.9, 9.1, "FAIL")]
    got = {(r.k, r.rule): (r.value, r.status) for r in rules.judged(df, rules.table(spark, told), ["k"]).collect()}
    assert got["a", "in 2021"] == (3.0, "PASS") and got["a", "all"] == (3.0, "WARN") and got["a", "peak"] == (2022.0, "PASS") and got["a", "yearly"] == (9.0, "PASS")
    assert got["b", "there"] == (0.0, "FAIL") and got["b", "in 2021"] == (None, "FAIL")
    for bad in ([told[0], told[0]], [("x", "x", "mode", None, None, 0.0, 1.0, "FAIL")], [("x", "x", "mean", D("2021-02-01"), D("2021-01-01"), 0.0, 1.0, "FAIL")]):
        with pytest.raises(ValueError, match="rules"):
            rules.table(spark, bad)


# contract


def test_each_violation_is_listed(spark):
    cell = ["rung", "seed"]
    rows = [(r, s, m, w, h, 0.1 * w + h, 0.0, 0.5) for r in (1, 2) for s in (0, 1) for m in ("base", "tuned") for w in range(3) for h in (1, 2)]
    good = {(r, s, m): 2 * 3.0 / sum(0.1 * w + h for w in range(3) for h in (1, 2)) for r in (1, 2) for s in (0, 1) for m in ("base", "tuned")}
    frames = lambda rows, saved, told: contract.violations(
        spark.createDataFrame(rows, "rung int, seed int, model string, window int, horizon int, actual double, prediction double, pinball double"),
        spark.createDataFrame(saved, "rung int, seed int, model string, horizon string, wql double"),
        spark.createDataFrame(told, "rung int, seed int, told_seed int"), cell, ["window", "horizon"], ("base", "tuned"), spark.createDataFrame([(1, 6), (2, 6)], "rung int, n_expected long"),
    )
    saved, told = [(*k, "overall", w) for k, w in good.items()], [(r, s, s) for r in (1, 2) for s in (0, 1)]
    assert frames(rows, saved, told).count() == 0
    wrong = [x for x in rows if x[:5] != (1, 0, "tuned", 2, 2)] + [(1, 1, "base", 0, 1, 1.0, 0.0, 0.5)]
    wrong = [(*x[:5], x[5] + 1, *x[6:]) if x[:5] == (2, 0, "tuned", 1, 1) else (*x[:6], math.inf, x[7]) if x[:5] == (2, 1, "base", 0, 2) else x for x in wrong]
    reported = [x for x in saved if x[:3] != (2, 1, "tuned")] + [saved[0]]
    got = {(r.rung, r.seed, r.model, r.kind): r.n for r in frames(wrong, reported, [(1, 0, 0), (1, 1, 9), (2, 0, 0)]).collect()}
    want = {(1, 0, "tuned", "wrong_row_count"): 1, (1, 0, None, "unpaired_key"): 1, (1, 1, "base", "repeated_key"): 1, (1, 1, "base", "wrong_row_count"): 1, (2, 0, None, "label_differs"): 1, (2, 1, "base", "not_finite"): 1, (2, 1, "tuned", "no_overall_row"): 1, (1, 0, "base", "several_overall_rows"): 2, (1, 1, None, "seed_differs"): 1, (2, 1, None, "no_metadata"): 1}
    metric = {(1, 0, "tuned", "metric_differs"): 1, (1, 1, "base", "metric_differs"): 1, (2, 0, "tuned", "metric_differs"): 1}
    assert got == want | metric


def test_one_to_one_raises(spark):
    rows = [("a", "x", 1.0), ("b", "x", 2.0), ("a", "y", 3.0)]
    kind = "side string, key string, v double"
    both = lambda rows: align.one_to_one(spark.createDataFrame(rows, kind), ["key"], "side", ("a", "b"), "v")
    assert [tuple(r) for r in both(rows).collect()] == [("x", 1.0, 2.0)]
    with pytest.raises(Exception, match="more than once"):
        both([*rows, ("b", "x", 2.0)]).collect()


# digests


def test_every_column_and_bit_counts(spark):
    kind = "i int, s string, d double, f float, t timestamp, day date, a array<double>, m map<string,int>, n struct<x:int,y:string>, b binary"
    row = (1, "é|", 0.1, 0.25, datetime(2024, 1, 1, 0, 0, 0, 1), D("2024-01-01"), [1.0, None], {"p": 1, "q": 2}, (1, None), b"\x00")
    of = lambda *rows: tuple(digest.digest(spark.createDataFrame(list(rows), kind)).first())
    other = (2, "é", math.nextafter(0.1, 1), 0.5, datetime(2024, 1, 1, 0, 0, 0, 2), D("2024-01-02"), [None, 1.0], {"p": 1, "q": 3}, (None, "1"), b"")
    base_ = of(row)
    for i in range(len(row)):
        assert of((*row[:i], other[i], *row[i + 1 :])) != base_ and of((*row[:i], None, *row[i + 1 :])) != base_
    assert of(row, other) == of(other, row) and of(row, row) != of(row) and of() == (0, "0", "0")
    shuffled = spark.createDataFrame([row], kind).select("b", "s", "i", "d", "f", "t", "day", "a", "m", "n")
    assert tuple(digest.digest(shuffled).first()) == base_


@pytest.mark.parametrize("x", [0.0, -0.0, 1.0, -1.5, 2.0**52, 2.0**53 + 2, 1e-300, 5e-324, 1e308, math.inf, -math.inf, math.nan, 0.1, 3.0, 1 - 2**-53, 1 + 2**-52])
def test_doubles_by_bits(spark, x):
    rng = random.Random(repr(x))
    near = {v for v in (x, math.nextafter(x, math.inf), math.nextafter(x, -math.inf), -x, rng.uniform(-1e9, 1e9)) if not math.isnan(v)} if not math.isnan(x) else {x}
    texts = [r[0] for r in spark.createDataFrame([(v,) for v in near], "d double").select(digest._double(F.col("d"))).collect()]
    assert len(set(texts)) == len(near) and None not in texts


def test_changed_column_is_named(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "i int, s string, d double")
    b = a.withColumn("d", F.when(F.col("i") == 2, 2.0000000000000004).otherwise(F.col("d")))
    one, two = ({r.column: r.digest for r in digest.by_column(x).collect()} for x in (a, b))
    assert [c for c in one if one[c] != two[c]] == ["d"]


# run cells


def test_only_wanted_folders_are_opened(spark, tmp_path):
    rows = [(r, f, s, i) for r in ("20", "60", "60-broken") for f in ("1997", "1998") for s in ("0", "1") for i in range(3)]
    sinks.write_cells(spark.createDataFrame(rows, "rung string, fold string, seed string, x int"), str(tmp_path / "runs"), ["rung", "fold", "seed"])
    cells = sinks.read_cells(spark, str(tmp_path / "runs"), dict.fromkeys(["rung", "fold", "seed"], "[0-9]+")).where("fold = '1998'")
    assert sorted(map(tuple, cells.groupBy("rung", "fold", "seed").count().collect())) == [(r, "1998", s, 3) for r in ("20", "60") for s in ("0", "1")]
    scan = next(x for x in cells._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x)
    assert "RLIKE" in scan.split("PartitionFilters")[1] or "rlike" in scan.split("PartitionFilters")[1].lower()
    assert cells._jdf.queryExecution().executedPlan().toString().count("fold") > 1


# readiness and links


def test_gate_closes(spark):
    rows = {(r.condition, r.subject): r for r in checks.conditions(spark, SMALL, datetime(1999, 1, 4, 12)).collect()}
    ends = [r for (c, _), r in rows.items() if c == "table_end"]
    assert ends and all(r.expected == D("1998-12-31") and not r.ok for r in ends)
    late = {(r.condition, r.subject): r for r in checks.conditions(spark, SMALL, datetime(1999, 1, 4, 21), horizon=1000).collect()}
    assert all(r.expected == D("1999-01-04") for (c, _), r in late.items() if c == "table_end") and not late["horizon", "calendar"].ok


def test_first_statement_of_a_date(spark):
    link = lambda d, t="Statement", a="/newsevents/pressreleases/monetary{}a.htm": f'<a href="{a.format(d)}">{t}</a>'
    pages = spark.createDataFrame([(2, link("20240131") + link("20240320")), (1, link("20240131", "PDF") + link("20240320", " HTML ", "/newsevents/press/monetary/{}b.htm") + link("20240320")), (3, link("20240501", a="/pressmonetary{}a.htm") + link("20240501", a="/newsevents/pressreleases/monetary/{}a.htm") + link("20241399"))], "page int, html string")
    links = pages.select("page", F.posexplode(text.statement_links(F.col("html"), ["Statement", "HTML"])).alias("pos", "x")).select("page", "pos", "x.*")
    assert sorted((str(r.date), r.page, r.href) for r in text.first_per_date(links, ["page", "pos"]).collect()) == [("2024-01-31", 2, "/newsevents/pressreleases/monetary20240131a.htm"), ("2024-03-20", 1, "/newsevents/press/monetary/20240320b.htm")]


# landed rows


def test_repeats_are_counted_as_they_landed(spark, tmp_path):
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    line = lambda i, day: (i, 1, 1, 1, 2.0, 10.0 + i, 0.0, "N", "O", datetime(2020, 1, day))
    spark.createDataFrame([line(1, 2), line(2, 3), line(3, 3), line(4, 6)], kind).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, datetime(2020, 1, 2))], "o_orderkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    got = audit.price_validation(spark, str(tmp_path)).first()
    check = {r.check: r for r in audit.quality_checks(spark, str(tmp_path)).collect()}
    assert got.n_repeated == 1 and check["duplicate_dates"].value == 1 and check["duplicate_dates"].status == "FAIL"


def test_keep_last_and_fallback(spark):
    rows = [("a", 1, None), ("a", 2, 5.0), ("a", None, 7.0), (None, 9, 9.0)]
    last = landed.keep_last(spark.createDataFrame(rows, "k string, seq int, v double"), ["k"], "seq")
    assert last.columns == ["k", "seq", "v"] and [tuple(r) for r in last.collect()] == [("a", 2, 5.0)]
    a, b = spark.createDataFrame([(1, None)], "k int, v double"), spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    assert sorted(map(tuple, landed.fallback([("a", a), ("b", b)], ["k"]).collect())) == [(1, None, "a"), (2, 3.0, "b")]


def test_pairs_without_a_join(spark):
    for name in ("gain_by_horizon", "paired_predictions"):
        assert "Join" not in "".join(x for x in base.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "tuned" in x)
    rows = spark.createDataFrame([(1, "tuned", 3.0), (1, "base", 1.0), (2, "tuned", 1.0)], "w int, model string, wql double")
    assert [tuple(r) for r in evaluation.paired(rows, ["w"]).collect()] == [(1, 2.0)]
