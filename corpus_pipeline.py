"""A training corpus from documents: toxic and near-duplicate ones go, secrets are masked, sources mixed, tokens packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import stages
from quillon.llm.common import documents, scratch

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.drop_toxic),
    ("near_dedup", stages.drop_near_copies),
    ("secret_scan", stages.mask_secrets),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

#: Stages depend on a trained model, hashes and a tokenizer; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
