"""Registered queries: each applies one operator, with production parameters,
to its whole table and derives the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(column: str, modulus: int) -> Column:
    """Rows no model may learn from: crc32 of the id as text leaves 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == 2, F.lit(False))


def sha256(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import drop_shared_passages
    return drop_shared_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", sha256("kept_text").alias("kept_sha256"))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_tree import score
    scored = score(table(spark, sf_dir, "documents"), ~held_out("doc_id", 7))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
                         "score", "bits_per_byte")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules as q
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = q.fit(docs, table(spark, sf_dir, "labels"))
    return q.judge(docs, rules).select("doc_id", *q.BASE, "base_failed", "kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import drop_repeated_strings
    return drop_repeated_strings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", sha256("kept").alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minmax_dedup import components_of
    return components_of(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import TARGETS, mix, word_count
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", *[lv.key().alias(lv.name) for lv in TARGETS], "epoch",
                            word_count("text").alias("n_tokens"))


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import compression_quality as q
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = q.fit(docs, table(spark, sf_dir, "labels"), ~held_out("id", 4))
    return q.score(docs, model).select("doc_id", held_out("doc_id", 4).alias("held_out"), "score",
                                       F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import nearest
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_repeated_lines
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", sha256("kept_text").alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit_texts
    return audit_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations
    return collocations(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .positional_index import decontaminate
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_substring_dedup, op2_context_tree, op3_quality_rules, op4_suffix_dedup, op5_packing, op6_minmax_dedup, op7_mixing, op8_compression_quality, op9_multi_index,
        op10_line_dedup, op11_filter_audit, op12_collocations, op13_decontamination)
}
