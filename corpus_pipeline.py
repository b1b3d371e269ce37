"""Corpus pipeline: rules, line dedup, near-duplicate removal, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  :func:`run` writes each stage's
result to the shared folder as Parquet and hands the table on, so a lost
executor costs a stage's tasks and no earlier stage.

Rows are handled one by one: null or repeated ids, null and empty texts and
extra columns go through every stage as its operator's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import line_dedup, minmax_dedup, mixing, packing, quality_rules
from llm.catalog import table
from llm.common import SPACE_CLASS, importable, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the decision list, learned from ``labels``, does not reject."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one holds (``n_chars``
    follows).  A document of which that leaves no word is a copy and goes."""
    importable(spark)
    out = ("_kept_text", "_n_lines", "_n_dropped")
    kept = line_dedup.drop_repeated_lines(docs, out=out)
    kept = kept.where((F.col(out[2]) == 0) | F.col(out[0]).rlike(f"[^{SPACE_CLASS[1:]}"))
    new = {"text": F.col(out[0]), "n_chars": F.length(out[0]).cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    importable(spark)
    return minmax_dedup.dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill the target weights, once per epoch they are used in."""
    return mixing.mix(docs, epoch="_epoch").select(*[f"`{c}`" for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2,048."""
    importable(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mixed),
    ("packing", packed),
]

#: Learned rules, token ids and seeded hashes are beyond SQL: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, in order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
