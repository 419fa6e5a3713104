"""Corpus pipeline: toxicity, near-duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
`docs`. All but the last return the columns of `documents`. The stages judge documents by themselves, so rows of any id, nulls and
empty texts pass through as their operators say; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlab.llm import mixing, neardup, packing, paragraphs, toxicity
from marketlab.llm.common import load, query, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("minhash_near_dedup", neardup.stage),
    ("substring_dedup", paragraphs.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Training and tokenising can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the pipeline over the table `documents`."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


query("pipeline")(run)
