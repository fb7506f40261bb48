"""Rules as a table: a statistic of a column over a period must lie between two bounds. All are answered in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.operators import quality

SCHEMA = "rule string, column string, stat string, from_date date, to_date date, low double, high double, on_miss string"

#: What a rule may ask of the values of its period.
STATS = ("mean", "std", "median", "min", "max", "negative_share", "present_share", "year_of_max", "year_of_min", "sum_a_year")


def statistics() -> dict[str, Column]:
    """Each of STATS over value and date; nulls count for the share that is present only, and of equal extremes the first day's year."""
    x, d = F.col("value"), F.col("date")
    day, there = F.datediff(d, F.lit("1970-01-01").cast("date")), x.isNotNull()
    return {
        "mean": F.avg(x),
        "std": F.stddev_samp(x),
        "median": F.percentile(F.when(F.col("stat") == "median", x), 0.5),
        "min": F.min(x),
        "max": F.max(x),
        "negative_share": F.avg((x < 0).cast("int")),
        "present_share": F.count(x) / F.count("*"),
        "year_of_max": F.year(F.max_by(d, F.when(there, F.struct(F.round(x, 9), -day)))).cast("double"),
        "year_of_min": F.year(F.min_by(d, F.when(there, F.struct(F.round(x, 9), day)))).cast("double"),
        "sum_a_year": ratio(F.sum(x), F.count_distinct(F.year(d))),
    }


def table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """Rules from tuples as SCHEMA has them; an open end is None. A repeated name, an unknown statistic or an empty period raises."""
    names = [r[0] for r in rules]
    wrong = [r[0] for r in rules if r[2] not in STATS or r[7] not in ("FAIL", "WARN") or (r[3] and r[4] and r[3] > r[4])]
    if wrong or len(set(names)) != len(names):
        raise ValueError(f"rules are not well made or repeated: {wrong or names}")
    return spark.createDataFrame(rules, SCHEMA)


def judged(df: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule, n, value, status for each rule that has rows in its period: PASS, or what the rule says of a miss; a statistic without values misses.

    Cells meet the rules of their column and period in one join (rules are declared, so few, and broadcast), and all statistics
    of all rules come from one aggregation."""
    columns = sorted({r["column"] for r in rules.select("column").distinct().collect()})
    cells = quality.melted(df, [*keys, "date"], columns)
    met = cells.join(F.broadcast(rules), "column").where((F.col("from_date").isNull() | (F.col("date") >= F.col("from_date"))) & (F.col("to_date").isNull() | (F.col("date") <= F.col("to_date"))))
    stats = met.groupBy(*keys, "rule", "stat", "low", "high", "on_miss").agg(F.count("value").alias("n"), *(c.alias(f"__{n}") for n, c in statistics().items()))
    value = F.coalesce(*(F.when(F.col("stat") == n, F.col(f"__{n}")) for n in STATS))
    fine = F.coalesce(value.between(F.col("low"), F.col("high")), F.lit(False))
    return stats.select(*keys, "rule", "n", value.alias("value"), F.when(fine, "PASS").otherwise(F.col("on_miss")).alias("status"))
