"""From raw documents to packed training sequences: quality, near copies, repeated passages, benchmark leaks, packing.

Each stage reads what the one before it wrote, and its decisions take effect: rejected documents, further copies and
contaminated documents go, repeated passages are cut from the texts. SQL can't express the estimates and the packing, so
there is no ``ORACLE_SQL``; the stages are tested against brute force.

All but the last return the columns of ``docs`` as they were, whatever their names; those named like an operator's results stay
the documents' own. Every stage takes an empty table to an empty one and works on whole texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import decontaminate, ngram_join, packing, quality, substring_dedup
from lamella.llm.common import guarded, materialise

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep. Null and empty texts go; equal rows stay or go together."""
    return guarded(docs, ["text", "lang", "source"], lambda d: quality.judge(d).where("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 80 % of their five-word shingles in common. Texts without words stay, each its own."""
    return ngram_join.dedup(docs, k=5, share=(4, 5))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of 20 words or more that an earlier place has. One that is left without words stays, empty; a null text stays null."""

    def cut(d: DataFrame) -> DataFrame:
        made = substring_dedup.dedup(d)
        out = made.withColumn("text", F.col("kept_text"))
        return out.withColumn("n_chars", F.length("kept_text").cast(d.schema["n_chars"].dataType)) if "n_chars" in d.columns else out

    return guarded(docs, [c for c in ("doc_id", "text", "n_chars") if c in docs.columns], cut)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item; null and empty texts have none."""
    return guarded(docs, ["text"], lambda d: decontaminate.scan(d, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, with their ids; a null text is an end token alone."""
    return packing.pack(docs.select("doc_id", "text", "lang", "source"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_copies), ("substring dedup", repeated_passages), ("benchmark decontamination", benchmark_leaks), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
