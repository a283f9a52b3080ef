"""Training-data pipeline: each stage reads what the one before kept, written as Parquet in between."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm.common import scratch_root, table
from quillstone.llm.decontamination import drop_leaks
from quillstone.llm.near_dedup import drop_near_duplicates
from quillstone.llm.packing import pack
from quillstone.llm.pii import redact
from quillstone.llm.quality_rules import fit_crf, keep_quality, training_rows


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the line labelling rejects go, with them null and empty texts."""
    return keep_quality(docs, fit_crf(training_rows(docs, table(spark, sf_dir, "labels"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays (five-word shingles, similarity of 0.8), also of rows of an equal or no doc_id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark passage go; null and empty texts hold none."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; personal data in its text is replaced by its kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null text is the empty text and one end token."""
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", redact_pii), ("packing", packing)]

#: Line labelling, near copies, span classification and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
