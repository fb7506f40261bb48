"""Window functions over (series, date)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.functions.scalars import ratio


def by(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def lag(c: str, w: WindowSpec, n: int = 1) -> Column:
    return F.lag(c, n).over(w)


def pct_change(c: str, w: WindowSpec, n: int = 1) -> Column:
    return ratio(F.col(c), lag(c, w, n)) - 1


def log_return(c: str, w: WindowSpec) -> Column:
    return F.ln(ratio(F.col(c), lag(c, w)))


def rolling(fn, c: Column | str, w: WindowSpec, rows: int, least: int | None = None) -> Column:
    """fn over the last `rows` rows, NULL with fewer than `least` (all) values."""
    frame = w.rowsBetween(1 - rows, 0)
    return F.when(F.count(c).over(frame) >= (least or rows), fn(c).over(frame))


def ffill(c: Column | str, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def ewm(c: str, w: WindowSpec, halflife: int) -> Column:
    """Exponential mean with weights 2^(-age/halflife), nulls keeping their places; weights below 2^-53 are beyond a double."""
    held = F.collect_list(F.struct(F.col(c).alias("x"))).over(w.rowsBetween(1 - 53 * halflife, 0))
    decay = 0.5 ** (1 / halflife)

    def step(acc: Column, v: Column) -> Column:
        there = v["x"].isNotNull()
        num = acc["num"] * decay + F.when(there, v["x"]).otherwise(F.lit(0.0))
        return F.struct(num.alias("num"), (acc["den"] * decay + there.cast("double")).alias("den"))

    zero = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    return F.aggregate(held, zero, step, lambda a: F.try_divide(a["num"], a["den"]))


def average_rank(c: str, w_keys: list[str]) -> Column:
    tied = Window.partitionBy(*w_keys, c)
    return F.rank().over(Window.partitionBy(*w_keys).orderBy(c)) + (F.count("*").over(tied) - 1) / 2


def price_features(w: WindowSpec) -> dict[str, Column]:
    """Overnight gap, mean daily range volatility (Parkinson), log momentum, log distance to means, z-score of the log volume."""
    volume = F.ln(F.when(F.col("volume") > 0, F.col("volume")))
    mean, std = rolling(F.avg, volume, w, 20, 15), rolling(F.stddev_samp, volume, w, 20, 15)
    daily = F.sqrt(F.pow(F.ln(ratio(F.col("high"), F.col("low"))), 2) / F.lit(4 * 0.6931471805599453))
    return {
        "overnight_gap": F.ln(ratio(F.col("open"), lag("close", w))),
        "range_vol": rolling(F.avg, daily, w, 22, 15),
        "momentum_21": F.ln(ratio(F.col("close"), lag("close", w, 21))),
        "momentum_63": F.ln(ratio(F.col("close"), lag("close", w, 63))),
        "dist_ma50": F.ln(ratio(F.col("close"), rolling(F.avg, "close", w, 50, 40))),
        "dist_ma200": F.ln(ratio(F.col("close"), rolling(F.avg, "close", w, 200, 150))),
        "volume_z": ratio(volume - mean, F.nullif(std, F.lit(0.0))),
    }
