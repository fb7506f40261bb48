"""Availability alignment: every value reaches the first session at which it could be known. Windows are partitioned by series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(base: DataFrame, other: DataFrame, columns: list[str], keys: list[str], at: str = "date", avail: str = "avail", ties: list[str] = (), lag_days: int = 0, suffix: str = "", last: date | None = None, span: int = 256) -> DataFrame:
    """base with each column's last known value at `at`: inclusive, each column on its own, of equal availability the latest by `ties`, then by value.

    A segmented scan. Values are first reduced to one row a series and day of availability. Each series is cut into ranges of
    `span` days, and each range is scanned on its own, base rows and values in one order, so that a long series takes as many
    tasks as it has ranges and any number of columns one shuffle. What a range's end knows of each column is carried into the
    ranges behind it by a row at their start; these rows come from a second pass over one row a range. `last` is the last day
    that base may have (else it is looked up).
    """
    cut = lambda day: F.floor(F.datediff(day, F.lit(date(1970, 1, 1))) / span)
    named = [f"{c}{suffix}" for c in columns]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*ties, c))).alias(n) for c, n in zip(columns, named)]
    known = other.groupBy(*keys, F.date_add(avail, lag_days).alias("__t")).agg(*newest).withColumn("__range", cut(F.col("__t")))
    # what each range's end knows, then a row for every later range up to the next one with values, and one for all others
    ends = known.groupBy(*keys, "__range").agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("__t"))).alias(n) for n in named))
    order = Window.partitionBy(*keys).orderBy("__range")
    end = F.floor(F.datediff(F.lit(last), F.lit(date(1970, 1, 1))) / span) if last else F.col("__end")
    if not last:
        ends = ends.crossJoin(F.broadcast(base.agg(cut(F.max(at)).alias("__end"))))  # one row
    upto = F.greatest(F.coalesce(F.lead("__range").over(order), end), F.col("__range") + 1)
    held = [F.last(n, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in named]
    carried = ends.select(*keys, "__range", upto.alias("__upto"), *held).withColumn("__to", F.explode(F.sequence(F.col("__range") + 1, F.col("__upto"))))
    carried = carried.select(*keys, F.date_add(F.lit(date(1970, 1, 1)), (F.col("__to") * span).cast("int")).alias("__t"), F.lit(-1).alias("__side"), F.col("__to").alias("__range"), *named)
    rows = base.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), cut(F.col(at)).alias("__range"), F.struct(*base.columns).alias("__row"))
    both = rows.unionByName(known.withColumn("__side", F.lit(0)).unionByName(carried), allowMissingColumns=True)
    scan = Window.partitionBy(*keys, "__range").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.select("__side", "__row", *(F.last(n, ignorenulls=True).over(scan).alias(n) for n in named))
    return seen.where("__side = 1").select("__row.*", *named)


def window_mean_join(base: DataFrame, other: DataFrame, columns: list[str], day_map: DataFrame, keys: list[str], first: Column, last: Column, clip_head: bool = False) -> DataFrame:
    """Means of what became available for each session of base: the first session on or after `avail`. What comes before the first session counts there (unless `clip_head`); what comes after the last is dropped."""
    to = F.greatest(F.col("next_on_or_after"), first)
    dealt = other.join(F.broadcast(day_map.select(F.col("date").alias("avail"), "next_on_or_after")), "avail").withColumn("date", to)
    dealt = dealt.where((F.col("date") <= last) & ((F.col("avail") >= first) | F.lit(not clip_head)))
    return base.join(dealt.groupBy(*keys, "date").agg(*(F.avg(c).alias(c) for c in columns)), [*keys, "date"], "left")


def publication_date(refs: DataFrame, business: DataFrame, sessions: DataFrame, ref: str = "ref_date", cutover: str | None = None) -> DataFrame:
    """refs with `published`: the session strictly after the business day strictly after the reference; from the cutover on the reference itself is the release."""
    release = refs.join(F.broadcast(business.select(F.col("date").alias(ref), F.col("next_after").alias("__next"))), ref, "left")
    day = F.when(F.col(ref) >= F.lit(cutover).cast("date"), F.col(ref)).otherwise(F.col("__next")) if cutover else F.col("__next")
    return release.withColumn("release", day).drop("__next").join(F.broadcast(sessions.select(F.col("date").alias("release"), F.col("next_after").alias("published"))), "release", "left")


def first_close_after(events: DataFrame, day_map: DataFrame, at: str = "accepted", filed: str = "filed") -> DataFrame:
    """events with `available`, the first session that closes strictly after the instant (a missing one: 23:59 New York on the filing date), and `phase` pre or post."""
    end = F.to_utc_timestamp(F.to_timestamp(F.concat(F.col(filed).cast("string"), F.lit(" 23:59:00"))), "America/New_York")
    instant = F.coalesce(F.col(at), end)
    local = F.from_utc_timestamp(instant, "America/New_York").cast("date")
    joined = events.withColumn("__at", instant).withColumn("__day", local).join(F.broadcast(day_map.withColumnRenamed("date", "__day")), "__day", "left")
    available = F.when((F.col("next_on_or_after") > F.col("__day")) | (F.col("__at") < F.col("close_ts")), F.col("next_on_or_after")).otherwise(F.col("next_after"))
    return joined.withColumn("available", available).withColumn("phase", F.when(F.col("available") == F.col("__day"), "pre").otherwise("post")).drop("__at", "__day", "next_on_or_after", "next_after", "close_ts")


def vintage_as_known(vintages: DataFrame, keys: list[str]) -> DataFrame:
    """For each release (keys, realtime_start): ref_month (the newest month known), level, yoy within what was known then, is_new_print."""
    newest = vintages.groupBy(*keys, "realtime_start").agg(F.max("ref_month").alias("m"))
    run = Window.partitionBy(*keys).orderBy("realtime_start")
    releases = newest.select(*keys, "realtime_start", F.max("m").over(run).alias("ref_month"))
    releases = releases.withColumn("is_new_print", F.coalesce(F.col("ref_month") > F.lag("ref_month").over(run), F.lit(True)))
    last = vintages.groupBy(*keys, "ref_month", "realtime_start").agg(F.max_by("value", "seq").alias("value"))

    def known(wanted: DataFrame, month: Column, name: str) -> DataFrame:
        rows = wanted.withColumn("__m", month).withColumn("__side", F.lit(1))
        both = rows.unionByName(last.select(*keys, F.col("ref_month").alias("__m"), "realtime_start", F.lit(0).alias("__side"), F.col("value").alias(name)), allowMissingColumns=True)
        seen = F.last(name, True).over(Window.partitionBy(*keys, "__m").orderBy("realtime_start", "__side"))
        return both.withColumn(name, seen).where("__side = 1").drop("__m", "__side")

    level = known(releases, F.col("ref_month"), "level")
    both = known(level, F.add_months("ref_month", -12), "year_ago")
    return both.withColumn("yoy", F.try_divide("level", "year_ago") - 1).drop("year_ago")


def merge_cache(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Cell-wise upsert: a new value that isn't null wins, else the old one stays."""
    a, b = (d.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in columns)) for d, s in ((old, "old"), (new, "new")))
    return a.join(b, keys, "full").select(*keys, *(F.coalesce(f"{c}_new", f"{c}_old").alias(c) for c in columns))


def one_to_one(rows: DataFrame, keys: list[str], side: str, names: tuple[str, str], value: str) -> DataFrame:
    """keys and, of two sides of rows, the value of each as <name>: keys that both sides have. A key that a side has twice stops the job.

    Both sides come from one pass and one shuffle, without a join."""
    of = lambda n: F.col(side) == n
    each = rows.where(F.col(side).isin(*names)).groupBy(*keys).agg(*(f for i, n in enumerate(names) for f in (F.count_if(of(n)).alias(f"__n{i}"), F.max(F.when(of(n), F.col(value))).alias(n))))
    message = F.concat(F.lit("key more than once on a side: "), F.to_json(F.struct(*keys)))
    single = F.when((F.col("__n0") > 1) | (F.col("__n1") > 1), F.raise_error(message).cast("boolean")).otherwise((F.col("__n0") == 1) & (F.col("__n1") == 1))
    return each.where(single).select(*keys, *names)


def horizon_covered(origins: DataFrame, days: DataFrame, keys: list[str], steps: int, columns: list[str]) -> DataFrame:
    """Of each origin (keys, idx): covered, whether the next `steps` rows of days are all there with no null in `columns`."""
    need = origins.select(*keys, F.col("idx").alias("origin"), F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + steps)).alias("idx"))
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull()
    have = days.select(*keys, "idx", full.alias("full"))
    return need.join(have, [*keys, "idx"], "left").groupBy(*keys, "origin").agg(F.bool_and(F.coalesce("full", F.lit(False))).alias("covered"))
