"""Tables out and back in: a feature table with its roles and metadata, statements as JSON lines, run cells by their names."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import digest


def write_feature_table(df: DataFrame, path: str, roles: dict[str, tuple[str, str]], by: str | None = None) -> None:
    """Writes <path>/table (Parquet, in folders by the column `by`), <path>/roles and <path>/metadata (JSON lines).

    `roles` names group and role of each column but the keys; a column of df without them, other than keys with no role at
    all, is not refused, but a role without a column is. The metadata holds the number of rows and the digest of the table
    as it was written, which `read_feature_table` compares."""
    spark = df.sparkSession
    lost = [c for c in roles if c not in df.columns]
    if lost:
        raise ValueError(f"roles without a column: {lost}")
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{path}/table")
    spark.createDataFrame([(c, g, r) for c, (g, r) in roles.items()], '`column` string, `group` string, role string').coalesce(1).write.mode("overwrite").json(f"{path}/roles")
    columns = [*df.columns]
    made = digest.digest(spark.read.parquet(f"{path}/table").select(columns))
    made.withColumn("columns", F.lit(json.dumps(columns))).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_feature_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """The table and its roles; a table that is not the one the metadata was made of raises."""
    meta = spark.read.json(f"{path}/metadata").first()
    columns = json.loads(meta["columns"])
    df = spark.read.parquet(f"{path}/table").select(columns)
    now = digest.digest(df).first()
    changed = [c for c in ("n_rows", "digest_a", "digest_b") if now[c] != meta[c]]
    if changed:
        raise ValueError(f"the table has changed since it was written: {changed}")
    roles = {r["column"]: (r["group"], r["role"]) for r in spark.read.json(f"{path}/roles").toLocalIterator()}
    return df, roles


def write_statements(df: DataFrame, path: str) -> None:
    """Statements as JSON lines, missing fields left out."""
    df.write.mode("overwrite").json(path)


def read_statements(spark: SparkSession, path: str, fields: str = "date date, url string, text string") -> DataFrame:
    """Statements from JSON lines; a line that is no JSON object raises."""
    return spark.read.schema(fields).option("mode", "FAILFAST").json(path)


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return (root if ":/" in root else f"file://{root}").rstrip("/")


def write_cells(df: DataFrame, path: str, names: list[str]) -> None:
    """Run cells in folders by the columns `names`; rows of a cell lie together."""
    df.repartition(*names).write.mode("errorifexists").partitionBy(*names).parquet(path)


def read_cells(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Run cells of folders whose values match their patterns, as strings; other folders are left out and, as the names are partition columns, never opened."""
    df = spark.read.option("basePath", path).parquet(path)
    cells = df.select(*(F.col(c).cast("string").alias(c) if c in names else c for c in df.columns))
    for c, pattern in names.items():
        cells = cells.where(F.col(c).rlike(f"^(?:{pattern})$"))
    return cells


def read_files(spark: SparkSession, paths: str | list[str], pattern: str, names: list[str]) -> DataFrame:
    """Run cells of Parquet files whose path matches `pattern`, with its groups as columns `names`; files whose path does not match are left out."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    of = df.withColumn("__path", F.col("_metadata.file_path"))
    kept = of.where(F.col("__path").rlike(pattern))
    return kept.withColumns({n: F.regexp_extract("__path", pattern, i + 1) for i, n in enumerate(names)}).drop("__path")


def changed_sources(now: DataFrame, before: DataFrame) -> DataFrame:
    """table, change: which of the sources were added, removed or changed between two sets of digests (table, n_rows, digest_a, digest_b)."""
    a = now.select("table", F.struct("n_rows", "digest_a", "digest_b").alias("now"))
    b = before.select("table", F.struct("n_rows", "digest_a", "digest_b").alias("before"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("now").eqNullSafe(F.col("before")), "changed")
    return a.join(b, "table", "full").select("table", change.alias("change")).where("change is not null")
