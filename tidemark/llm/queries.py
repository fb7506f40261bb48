"""The queries opN_<name> of this subpackage: each applies its operator to whole tables and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, centroids, collocations, ctw, decontam, exact_dup, fingerprint, langid, near_dup, pii, rlz, suffix_repeats, token_files
from tidemark.llm._common import only
from tidemark.llm.oracle import ORACLE


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.findings(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    spans = F.col("spans")

    def count(k: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")

    counts = map(count, range(pii.BASE))
    terms = F.transform("terms", lambda t: F.struct(F.lit(pii.TERM_KIND).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    every = F.concat(F.transform(F.concat(spans, "secrets"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), terms)
    added = (F.size("secrets").cast("long").alias("n_secret"), F.size("terms").cast("long").alias("n_term"), (F.size(every) > 0).alias("personal"))
    return found.select("doc_id", *counts, F.sha2(pii.listed(spans).cast("binary"), 256).alias("base_sha256"), pii.listed(every).alias("spans"), *added)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.edited(table(spark, sf_dir, "documents"))
    mine, other, after = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", fingerprint.likeness(mine, other).alias("near_edited"), fingerprint.likeness(mine, after).alias("near_next"))


def op4_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.factorise(table(spark, sf_dir, "documents"), width=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    model = langid.fit(docs.where(remainder != 0))
    return langid.identify(only(docs, "doc_id", "text"), model).select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.remove_repeats(table(spark, sf_dir, "documents"), width=200)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ctw.score(table(spark, sf_dir, "documents"), modulus=7, remainder=2)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.round("score", 4).alias("score"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    coded = bpe.encode(docs, vocabulary()).drop("text")
    both = bpe.decode(coded, vocabulary())
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_documents(token_files.write(table(spark, sf_dir, "documents"), vocabulary(), end_id=2))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, final = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(found, final).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_near_dedup": op2_near_dedup,
    "op3_fingerprint": op3_fingerprint,
    "op4_rlz": op4_rlz,
    "op5_language_id": op5_language_id,
    "op6_suffix_repeats": op6_suffix_repeats,
    "op7_decontamination": op7_decontamination,
    "op8_ctw": op8_ctw,
    "op9_bpe": op9_bpe,
    "op10_token_files": op10_token_files,
    "op11_collocations": op11_collocations,
    "op12_centroids": op12_centroids,
    "op13_exact_dedup": op13_exact_dedup,
}


__all__ = ["ORACLE", "QUERIES"]
