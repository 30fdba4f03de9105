"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
to the shared folder and read again as the next stage's documents.  All but the last give
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veracity.llm.common import documents, stored
from veracity.llm.langid import language_stage
from veracity.llm.minhash import near_duplicate_stage
from veracity.llm.packing import packing_stage
from veracity.llm.recompress import substring_stage
from veracity.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated passages", substring_stage),
    ("packing", packing_stage),
]

#: The models and the packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
