"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits and bias correction.

Each word shingle is hashed once; the hash names a bin and the least hash of each bin is kept. An empty bin takes the value of
the first filled bin in a probe sequence that depends on the empty bin alone, so that equal sets fill alike. The low `BITS`
bits of each bin are packed as hexadecimal digits. Two fingerprints agree in a bin with probability J + (1 - J) 2^-BITS,
which the likeness takes out again.

All of it is DataFrame functions. A text of fewer words than a shingle has its whole word sequence as one shingle. A null
or empty text, or one without words, has the fingerprint '' and is like another such text (1) and nothing else (0). Equal
texts have equal fingerprints, repeated rows one each. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bins (a power of two), bits kept of each (4: one hexadecimal digit), words of a shingle.
BINS, BITS, WIDTH = 256, 4, 5
_SHIFT = 64 - BINS.bit_length() + 1
#: Probes tried one after the other for an empty bin, before all filled bins are ranked for it.
PROBES = 24


def word_array(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lowered."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def _shingles(hashes: Column) -> Column:
    """Hash of each run of WIDTH word hashes, or of the whole shorter sequence."""
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(1), n - WIDTH + 1), lambda i: F.xxhash64(*(F.element_at(hashes, i + k) for k in range(WIDTH))))
    return F.when(n >= WIDTH, runs).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.lit([]).cast("array<long>"))


def fingerprint(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with the fingerprint of `text` in `out`: one hexadecimal digit a bin."""
    words = F.transform(word_array(F.col(f"`{text}`")), lambda w: F.xxhash64(w))
    step = docs.withColumn("__h", words).withColumn("__h", F.sort_array(_shingles(F.col("__h"))))
    h, none = F.col("__h"), F.lit(None).cast("long")

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, _SHIFT).cast("int") + BINS // 2

    # sorted hashes lie bin by bin (the sign leads), so the first of each bin is its least
    step = step.withColumn("__h", F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1)))))
    # a value for each bin: before each least hash as many nulls as bins were skipped
    lead = F.transform(h, lambda x, i: F.concat(F.array_repeat(none, bin_of(x) - F.when(i == 0, F.lit(0)).otherwise(bin_of(F.get(h, i - 1)) + 1)), F.array(x)))
    step = step.withColumn("__f", F.flatten(lead))
    f = F.col("__f")

    def value(i: Column) -> Column:
        probes = (F.get(f, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES))
        ranked = F.array_min(F.transform(h, lambda x: F.struct(F.xxhash64(i, bin_of(x)).alias("rank"), x.alias("x"))))["x"]
        return F.coalesce(F.get(f, i), *probes, ranked)

    digits = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(F.lit("0123456789abcdef"), F.shiftright(value(i), 8).bitwiseAND(F.lit(15)).cast("int") + 1, F.lit(1)))
    return step.withColumn(out, F.when(F.size(h) > 0, F.array_join(digits, "")).otherwise(F.lit(""))).drop("__h", "__f")


def likeness(a: Column, b: Column) -> Column:
    """Similarity from 0 to 1 of the sets behind two fingerprints."""
    x, y = (F.split(c, "") for c in (a, b))
    same = F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, k: n + k)
    chance = 1 / (1 << BITS)
    estimate = (same / BINS - chance) / (1 - chance)
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))


def with_next(docs: DataFrame, key: str, *names: str) -> DataFrame:
    """docs with next_<name>: the columns of the row after it by descending key (after the last: the first).

    Keys are dealt by ranges, whose first keys come from quantiles; a range's first rows are also guests of the range before, so
    one shuffle and an ordering of each range give every row its follower. Nulls stand last, equal keys in the order of `names`.
    """
    n = 4 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(2**63)))
    shares = [k / n for k in range(1, n)]
    top, marks = docs.agg(F.max(at), F.percentile_approx(at, F.array(*map(F.lit, shares)), 100 * n)).first()
    firsts = sorted({top, *(marks or [])} - {None}, reverse=True)
    heads = F.array(*map(F.lit, firsts)).cast("array<long>")
    home = F.size(F.filter(heads, lambda x: x >= F.col("__at"))) - 1
    dealt = docs.withColumn("__at", at).withColumn("__range", home)
    before = F.pmod(F.col("__range") - 1, F.lit(max(1, len(firsts))))
    is_head = F.array_contains(heads, F.col("__at"))
    places = F.when(is_head, F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("guest")), F.struct(before.alias("r"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("guest"))))
    dealt = dealt.withColumn("__place", F.explode(places)).withColumn("__range", F.col("__place.r")).withColumn("__guest", F.col("__place.guest"))
    order = Window.partitionBy("__range").orderBy("__guest", F.desc("__at"), *names)
    dealt = dealt.withColumn("__next", F.lead(F.struct(*names)).over(order)).where("__guest = 0")
    return dealt.select(*docs.columns, *(F.col(f"__next.{c}").alias(f"next_{c}") for c in names))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, edited_text, edited_fingerprint, next_fingerprint: the edit puts the next document's beginning in place of the text's second half."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(fingerprint(rows, "text", "fingerprint"), "doc_id", "text", "fingerprint")
    half = F.floor(F.length("text") / 2).cast("int")
    cut = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint", cut.alias("edited_text"), "next_fingerprint")
    return fingerprint(rows, "edited_text", "edited_fingerprint")
