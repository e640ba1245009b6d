"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept; each result is written as
Parquet and read again as the next stage's input; a stage's input is deleted once
the next result is there.

Defined results, the operators' own: documents without text are judged by their
form, have no words to link or to contaminate, and pack as their end id alone;
rows that repeat an id are told apart by their text, and exact repeats leave one
row; null ids are kept; a very long text is worked on in the tasks that hold it;
among equals the smallest id stays; columns of any name are kept up to the last
stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltide.llm import decontaminate, near_dedup, packing, quality, secrets
from voltide.session import delete_path, scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: poor or toxic ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (0.8 or more) stays."""
    return near_dedup.deduplicate(docs, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents over the contamination limit go; all others stay as they are."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it are masked."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack_examples(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: Two stages can't be put in SQL; tests compare all with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    out, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for n, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{n}")
        stage(spark, out, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return out
