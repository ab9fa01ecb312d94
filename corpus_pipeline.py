"""The training-corpus pipeline: quality, near-duplicates, repeated passages, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import mixing, packing, quality, recompression, simhash
from tallymark.llm.common import cut, table

#: ``(name, f(spark, docs, sf_dir) -> DataFrame)``; all but the last return the columns of documents.
STAGES = [
    ("quality", quality.quality_stage),
    ("near_duplicates", simhash.dedup_stage),
    ("repeated_passages", recompression.dedup_stage),
    ("mix", mixing.mix_stage),
    ("pack", packing.pack_stage),
]

#: Hashed models, sampling noise and tokenizers are outside SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is cut to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
