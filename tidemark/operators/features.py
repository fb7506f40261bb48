"""A feature table from a declared list: where each input comes from, when it could be known, and what is made of it.

Inputs of calendar-wide sources are aligned on the sessions, a row a day, once for all series. All inputs of the as-of rules,
whatever their sources and lags, are united and aligned in one scan; all means over sessions share one aggregation. The result
has a row a session and is broadcast to the series; differences and other transforms are taken on the series' own rows after
that, in one ordering of each series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.operators import align

#: When a value could be known: its own day and `lag` days, a publication rule, the mean of what came since the last session, or that session alone.
ASOF, PUBLISHED, SPREAD, MEAN, SESSION = "asof", "published", "spread", "mean", "session"


@dataclass(frozen=True)
class Input:
    """A column of a source as the feature list calls it."""

    name: str
    source: str
    column: str
    rule: str = ASOF
    lag: int = 0


@dataclass(frozen=True)
class Feature:
    """A column of the table: its group and role, and how it is made of the aligned columns (itself, if not told)."""

    name: str
    group: str
    role: str
    make: Callable[[WindowSpec], Column] | None = None


def roles(features: list[Feature]) -> list[tuple[str, str, str]]:
    """Column, group, role; a name declared twice raises."""
    names = [f.name for f in features]
    if len(set(names)) != len(names):
        raise ValueError(f"declared twice: {sorted({n for n in names if names.count(n) > 1})}")
    return [(f.name, f.group, f.role) for f in features]


def aligned(sessions: DataFrame, sources: dict[str, DataFrame], inputs: list[Input], business: DataFrame, day_map: DataFrame, first: date, last: date, cutover: str) -> DataFrame:
    """date and every input at each of the sessions (date). Inputs of sources that are absent are left out, to be told apart from missing values by the caller."""
    there = [i for i in inputs if i.source in sources]
    out = sessions

    def of(rule: str) -> dict[tuple[str, int], list[Input]]:
        groups: dict[tuple[str, int], list[Input]] = {}
        for i in there:
            if i.rule == rule:
                groups.setdefault((i.source, i.lag), []).append(i)
        return groups

    def named(df: DataFrame, some: list[Input], *kept: str) -> DataFrame:
        return df.select(*kept, *(F.col(i.column).alias(i.name) for i in some))

    def united(parts: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    known = [named(sources[s].withColumn("avail", F.date_add("date", lag)), some, "date", "avail") for (s, lag), some in of(ASOF).items()]
    for rule, cut in ((PUBLISHED, None), (SPREAD, cutover)):
        for (s, _), some in of(rule).items():
            known.append(named(align.publication_date(sources[s].withColumnRenamed("date", "ref"), business, day_map, "ref", cut), some, F.col("ref").alias("date"), F.col("published").alias("avail")))
    if known:
        rows = united(known).where("avail is not null").withColumnRenamed("date", "ref")
        out = align.asof_join(out, rows, [c for c in rows.columns if c not in ("ref", "avail")], [], ties=["ref"], last=last)
    means = [named(sources[s].withColumn("avail", F.date_add("date", lag)), some, "avail") for (s, lag), some in of(MEAN).items()]
    if means:
        rows = united(means)
        out = align.window_mean_join(out, rows, [c for c in rows.columns if c != "avail"], day_map, [], F.lit(first), F.lit(last))
    for (s, _), some in of(SESSION).items():
        out = out.join(named(sources[s], some, "date"), "date", "left")
    return out


def table(base: DataFrame, wide: DataFrame, features: list[Feature], w: WindowSpec, keep: list[str]) -> DataFrame:
    """The columns `keep` of base and all features, made of base and of `wide`, which has a row a session."""
    roles(features)
    both = base.join(F.broadcast(wide), "date", "left")  # a row a session, whatever the number of series
    made = {f.name: f.make(w) for f in features if f.make is not None}
    lost = [f.name for f in features if f.make is None and f.name not in both.columns]
    if lost:
        raise ValueError(f"neither made nor aligned: {lost}")
    return both.select(*keep, *(made.get(f.name, F.col(f.name)).alias(f.name) for f in features))
