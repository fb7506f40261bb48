"""Bootstraps and permutations with hashed draws: a retried task, another partitioning or another engine draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def drawn(*parts: Column | str | int, below: Column) -> Column:
    """A whole number from 0 to below - 1 that depends on the parts alone."""
    text = F.concat_ws("|", *(F.col(p) if isinstance(p, str) else F.lit(p).cast("string") if isinstance(p, int) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % below


#: Places of a draw that one row stands for until they are looked up, and values of a group that one row may hold.
CHUNK = 4096


def placed(df: DataFrame, groups: list[str], value: str, order: list[str]) -> DataFrame:
    """groups, place, value, n: the values of each group of n numbered from 0 in the given order.

    Rows are numbered within each part of a group that the leading order columns make, and parts by the sizes of those before,
    so that a group of many parts is never sorted in one task.
    """
    part = [c for c in order[:-1] if c not in groups]
    within = Window.partitionBy(*groups, *part)
    rows = df.select(*groups, *part, F.col(value).alias("value"), F.row_number().over(within.orderBy(order[-1])).alias("__i"), F.count("*").over(within).alias("__size"))
    if not part:
        return rows.select(*groups, (F.col("__i") - 1).cast("long").alias("place"), "value", F.col("__size").alias("n"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.where("__i = 1")  # one row a part
    start = sizes.select(*groups, *part, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"), F.sum("__size").over(whole).alias("n"))
    return rows.join(start, [*groups, *part]).select(*groups, (F.col("__start") + F.col("__i") - 1).alias("place"), "value", "n")


def _places(rows: DataFrame, groups: list[str], keep: list[str], first: Column, last: Column, block: int, seed: int) -> DataFrame:
    """groups, draw, keep, place: what the blocks from first to last of each row's draw take."""
    n = F.col("n")
    blocks = rows.select(*groups, *keep, "draw", "n", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("__block"))
    begun = blocks.withColumn("place", drawn(seed, F.concat_ws("/", *groups), F.col("draw"), F.col("__block"), below=n))
    if block > 1:
        begun = begun.withColumn("__off", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(block), n - F.col("__block") * block) - 1)))
        begun = begun.withColumn("place", (F.col("place") + F.col("__off")) % n)
    return begun.select(*groups, *keep, "draw", "place")


def draws(df: DataFrame, keys: list[str], value: str, order: list[str], n_draws: int, block: int = 1, seed: int = 7, within: list[str] = ()) -> DataFrame:
    """keys, draw, mean: means of resampled values, in circular blocks of `block` rows, the last cut to n; `within` strata are drawn alone and averaged.

    A group of up to `CHUNK` values is one array, sent once to each share of the draws, which take their values from it by place.
    A larger one is never held in a row or a task: the places of its draws are worked out `CHUNK` at a time over all tasks and
    meet the values in a join by place. Both add up sums by draw and give the same means.
    """
    groups = [*keys, *within]
    values = placed(df, groups, value, order)
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n, count = F.col("n"), min(n_draws, 4 * parts)
    ordered = F.array_sort(F.collect_list(F.struct("place", "value")))
    held = values.where(n <= CHUNK).groupBy(*groups, "n").agg(F.transform(ordered, lambda s: s["value"]).alias("held"))
    shares = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("share")).repartition(parts, *groups, "share")
    each = shares.select("*", F.explode(F.sequence(F.col("share"), F.lit(n_draws - 1), F.lit(count))).alias("draw"))
    near = _places(each, groups, ["held"], F.lit(0), F.ceil(n / block) - 1, block, seed).select(*groups, "draw", F.get("held", F.col("place").cast("int")).alias("value"))
    chunk = max(1, CHUNK // block)  # in blocks
    large = values.where(n > CHUNK)
    told = large.where("place = 0").select(*groups, "n", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"))
    told = told.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / (chunk * block)) - 1)).alias("part")).repartition(parts, *groups, "draw", "part")
    far = _places(told, groups, [], F.col("part") * chunk, F.least((F.col("part") + 1) * chunk, F.ceil(n / block)) - 1, block, seed)
    far = far.join(large.select(*groups, "place", "value"), [*groups, "place"]).select(*groups, "draw", "value")
    mean = near.unionByName(far).groupBy(*groups, "draw").agg(F.avg("value").alias("mean"))
    return mean.groupBy(*keys, "draw").agg(F.avg("mean").alias("mean")) if within else mean


def interval(drawn_means: DataFrame, keys: list[str]) -> DataFrame:
    """2.5 and 97.5 percentiles of the draws."""
    return drawn_means.groupBy(*keys).agg(F.percentile("mean", 0.025).alias("ci_lo"), F.percentile("mean", 0.975).alias("ci_hi"))


def donors(windows: DataFrame, keys: list[str], seed: int = 7) -> DataFrame:
    """One random cycle of the windows of each group: every window gets another's place (of a lone window, its own)."""
    w = Window.partitionBy(*keys).orderBy("__h", "window")
    hashed = windows.withColumn("__h", F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *keys, "window")))
    first = F.first("window").over(Window.partitionBy(*keys).orderBy("__h", "window"))
    return hashed.withColumn("donor", F.coalesce(F.lead("window").over(w), first)).drop("__h")


def tail_aligned(donor: Column, like: Column) -> Column:
    """The donor array cut or padded with nulls on its left to the length of `like`."""
    n, m = F.size(like), F.size(donor)
    return F.when(m >= n, F.slice(donor, m - n + 1, n)).otherwise(F.concat(F.array_repeat(F.lit(None).cast("double"), n - m), donor))
