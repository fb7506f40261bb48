"""From raw documents to token ids: language, near duplicates, benchmark passages, personal data, BPE.

Each stage reads all that its predecessor kept. The first four return the columns of documents. Null and empty texts have
no letter, so the first stage rejects them; rows that repeat a doc_id come down to one at the second. A document with a null
doc_id is a document of its own. Empty tables pass through every stage. Extra columns stay up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import bpe, decontam, langid, near_dup, pii
from tidemark.llm._common import stored
from tidemark.llm.queries import vocabulary

#: A document stays if its likeliest language has at least this share of its letters.
LANGUAGE_SHARE = 0.5
#: Words of a benchmark passage that make a document contaminated; shorter items are too common to tell.
PASSAGE = 5


def _unused(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """Names like these that no column of docs has."""
    mark = "_" * (1 + max(map(len, docs.columns)))
    return tuple(mark + n for n in names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; a missing label is filled in."""
    pred, share = _unused(docs, "lang", "share")
    named = langid.identify(docs, langid.fit(docs), names=(pred, share)).where((F.col(pred) != "und") & (F.col(share) >= LANGUAGE_SHARE))
    return named.select(*(F.coalesce(c, pred).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near duplicates (five-word shingles, similarity 0.8); of rows of one doc_id the first by text. A null doc_id stays."""
    nth, key = _unused(docs, "nth", "key")
    copies = near_dup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(key)).distinct()
    # copies go and rows are numbered by one key, so that texts are shuffled once
    keyed = docs.withColumn(key, F.coalesce("doc_id", F.xxhash64("text")))
    left = keyed.join(copies, (keyed[key] == copies[key]) & keyed["doc_id"].isNotNull(), "left_anti")
    again = Window.partitionBy(key).orderBy("doc_id", "text")
    return left.withColumn(nth, F.row_number().over(again)).where((F.col(nth) == 1) | F.col("doc_id").isNull()).select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; a row is known by doc_id and text, as the id may be null."""
    d, k = _unused(docs, "doc_id", "key")
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where(F.exists("spans", lambda s: s["end"] - s["start"] >= PASSAGE)).select(F.col("doc_id").alias(d), F.col("text_key").alias(k)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad[d]) & (decontam.text_key(docs["text"]) == bad[k])
    return docs.join(bad, same, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what gives it away replaced."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding them gives the text."""
    both = bpe.encode_and_decode(docs.select("doc_id", "text"), vocabulary())
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", tokens),
]

#: No stage but the fourth could be put into SQL; tests/llm hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
