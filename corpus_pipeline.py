"""The corpus pipeline: stages over the table of documents, each reading what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from millrace.llm.common import Written, table

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: Fuzzy matching, learned scores and semantic retrieval are beyond SQL; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`; each result is written as Parquet and read again as the next one's docs."""
    write = Written(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, write(stage(spark, docs, sf_dir))
        write.drop(before)
    return docs
