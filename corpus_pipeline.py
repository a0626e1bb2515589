"""The corpus pipeline: quality rules, language identification, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import language, neardup, packing, quality
from quillspark.llm.store import table

#: (name, function): each takes (spark, docs, sf_dir); its result is written as Parquet and read again for the next.
STAGES = [("quality", quality.stage), ("language", language.stage), ("neardup", neardup.stage), ("packing", packing.stage)]
#: Trained models and sketches are not expressible in SQL; tests/llm/test_plain.py compares every stage with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
