"""The corpus pipeline: stages over documents, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataform.llm.common import table, written
from strataform.llm.decontaminate import drop_leaks
from strataform.llm.line_dedup import drop_repeated_lines
from strataform.llm.near_dups import keep_one
from strataform.llm.packing import pack_documents
from strataform.llm.quality import KEEP, held_out, score_quality, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at KEEP or more."""
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score_quality(docs, model).where(F.col("score") >= KEEP).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave their documents; n_chars follows the text."""
    kept = drop_repeated_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: one with the smallest id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and offsets."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", packing),
]

#: SQL can't express the classifier, the sampling and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
