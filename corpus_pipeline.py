"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, mixture, token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm.common import discard, settle, table
from pairloom.llm.decontamination import decontamination_stage
from pairloom.llm.mixing import mixing_stage
from pairloom.llm.simhash import dedup_stage
from pairloom.llm.token_output import output_stage
from pairloom.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", output_stage),
]

#: The first, second, third and last stage cannot be put in SQL; tests/llm/test_queries.py holds a brute-force version of all five.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; what a stage wrote goes once the next has read it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, settle(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, before)
    return docs
