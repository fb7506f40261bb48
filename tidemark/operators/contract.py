"""What runs owe each other, as a list of violations: one row for each cell, model and kind that is broken, with how often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio

#: Kinds of violations, as the rows name them.
KINDS = ("repeated_key", "unpaired_key", "label_differs", "not_finite", "wrong_row_count", "no_overall_row", "several_overall_rows", "metric_differs", "seed_differs", "no_metadata")


def violations(rows: DataFrame, saved: DataFrame, told: DataFrame, cell: list[str], key: list[str], models: tuple[str, str], expected: DataFrame, tolerance: float = 1e-9, seed: str = "seed") -> DataFrame:
    """cell, model, kind, n of everything that is wrong in the runs.

    rows: cell, model, key, actual, prediction, pinball. saved: cell, model, horizon, wql as it was reported. told: cell,
    told_seed as the run's metadata has it. expected: some of cell, n_expected. Rows are read once: counters of a key are added
    up to those of a cell in two aggregations, and the small tables join behind them. A cell's own violations have a null model.
    """
    a, b = models
    per_key = rows.groupBy(*cell, "model", *key).agg(
        F.count("*").alias("copies"), F.min("actual").alias("actual"), F.max("actual").alias("other"), F.sum("pinball").alias("loss"), F.sum(F.abs("actual")).alias("scale"),
        F.count_if(~_finite(F.col("prediction")) | ~_finite(F.col("actual"))).alias("not_finite"),
    )
    one = per_key.groupBy(*cell, "model").agg(F.count_if(F.col("copies") > 1).alias("repeated_key"), F.sum("copies").alias("n_rows"), F.sum("loss").alias("loss"), F.sum("scale").alias("scale"), F.sum("not_finite").alias("not_finite"))
    side = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    pairs = per_key.groupBy(*cell, *key).agg(F.count_if(F.col("model").isin(a, b)).alias("sides"), F.min("actual").alias("lo"), F.max("other").alias("hi"))
    both = pairs.groupBy(*cell).agg(F.count_if(F.col("sides") != 2).alias("unpaired_key"), F.count_if(F.col("hi") - F.col("lo") > tolerance).alias("label_differs"))
    reports = saved.where("horizon = 'overall'").groupBy(*cell, "model").agg(F.count("*").alias("overall_rows"), F.max("wql").alias("reported"), F.min("wql").alias("least"))
    shared = [c for c in expected.columns if c in cell]
    each = one.join(reports, [*cell, "model"], "left").join(F.broadcast(expected), shared, "left")  # a row a fold
    found = F.coalesce("overall_rows", F.lit(0))
    off = F.greatest(F.abs(F.col("reported") - _wql()), F.abs(F.col("least") - _wql())) > tolerance
    own = {
        "repeated_key": F.col("repeated_key"), "not_finite": F.col("not_finite"), "wrong_row_count": F.when(~F.col("n_rows").eqNullSafe(F.col("n_expected")), F.abs(F.col("n_rows") - F.coalesce("n_expected", F.lit(0)))),
        "no_overall_row": (found == 0).cast("long"), "several_overall_rows": F.when(found > 1, found), "metric_differs": F.coalesce(off, F.lit(False)).cast("long"),
    }
    meta = both.join(told, cell, "left")
    cells = {
        "unpaired_key": F.col("unpaired_key"), "label_differs": F.col("label_differs"),
        "seed_differs": F.coalesce(F.col("told_seed") != F.col(seed), F.lit(False)).cast("long"), "no_metadata": F.col("told_seed").isNull().cast("long"),
    }
    return _listed(each, [*cell, "model"], own).unionByName(_listed(meta.withColumn("model", F.lit(None).cast("string")), [*cell, "model"], cells))


def _finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def _wql() -> Column:
    return 2 * ratio(F.col("loss"), F.col("scale"))


def _listed(df: DataFrame, ids: list[str], counts: dict[str, Column]) -> DataFrame:
    """ids, kind, n of the counts that aren't 0."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(c, F.lit(0)).cast("long").alias("n")) for k, c in counts.items())))
    return df.select(*ids, each.alias("v")).select(*ids, "v.*").where("n > 0")
