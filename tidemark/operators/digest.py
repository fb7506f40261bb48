"""An order-free digest of whole tables: every column of every row counts, each by a text that its type alone decides.

Doubles go by mantissa and exponent, so that two values differ in the text if and only if they differ in bits (all NaN are one);
timestamps by microseconds since 1970 in UTC; dates by days; strings and binaries by length and content; nested values in order;
a null is told from every value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = "~"


def _double(c: Column) -> Column:
    """Sign, 53-bit mantissa and exponent of a double in whole numbers; 0, infinities and what is nearly subnormal by name or decimal text."""
    a = F.abs(c)
    guess = F.floor(F.log2(a))
    e = F.when(F.pow(F.lit(2.0), guess) > a, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= a, guess + 1).otherwise(guess)
    mantissa = F.floor(a * F.pow(F.lit(2.0), 52 - e)).cast("long")
    normal = F.concat(F.when(c < 0, "-").otherwise(""), mantissa.cast("string"), F.lit("p"), e.cast("string"))
    return F.when(F.isnan(c), "nan").when((a > 1e-250) & (a < 1e250), normal).otherwise(c.cast("string"))


def canonical(c: Column, kind: T.DataType) -> Column:
    """The text of a value."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        text = _double(c.cast("double"))
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(c).cast("string")
    elif isinstance(kind, T.TimestampNTZType):
        text = F.unix_micros(F.to_utc_timestamp(c, "UTC")).cast("string")
    elif isinstance(kind, T.DateType):
        text = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("string")
    elif isinstance(kind, T.StringType):
        text = F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.hex(c))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        text = F.concat(F.lit("<"), F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda x: canonical(x, entry))), ","), F.lit(">"))
    elif isinstance(kind, T.StructType):
        text = F.concat(F.lit("{"), F.concat_ws(",", *(canonical(c[f.name], f.dataType) for f in kind.fields)), F.lit("}"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(NULL))


def digest(df: DataFrame) -> DataFrame:
    """n_rows, digest_a, digest_b: the sums of two 60-bit halves of each row's md5. Columns count by name, whatever their order."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    text = F.md5(F.concat_ws("|", *(canonical(F.col(f"`{f.name}`"), f.dataType) for f in fields)))
    half = [F.conv(F.substring(text, k, 15), 16, 10).cast("decimal(38,0)") for k in (1, 16)]
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(half[0]), F.lit(0)).cast("string").alias("digest_a"), F.coalesce(F.sum(half[1]), F.lit(0)).cast("string").alias("digest_b"))


def by_column(df: DataFrame) -> DataFrame:
    """column, digest: a sum for each column of the whole table, over its values and how often each stands there."""
    fields = df.schema.fields
    part = lambda f: F.sum(F.conv(F.substring(F.md5(canonical(F.col(f"`{f.name}`"), f.dataType)), 1, 15), 16, 10).cast("decimal(38,0)"))
    sums = df.agg(*(F.coalesce(part(f), F.lit(0)).cast("string").alias(f.name) for f in fields))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("digest")) for f in fields))).alias("x")).select("x.*")
