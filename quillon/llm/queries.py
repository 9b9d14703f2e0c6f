"""The operators as queries over the tables of a folder, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, imatch, mixing, near_dedup, packing, quality, secret_scan, sharding, suffix_dedup, toxicity, wand, whitening
from .common import documents
from .oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op2_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), with_bytes=False).drop("kept")


def op4_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(documents(spark, sf_dir))


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(documents(spark, sf_dir))


def op6_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op8_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op9_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op10_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op11_chan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.search(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op13_batched_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def queries() -> dict:
    own = (op1_chat_formatting, op2_minmax_near_dedup, op3_suffix_array_dedup, op4_imatch_fingerprints, op5_secret_ledger, op6_sainte_lague_mixing, op7_line_frequency_quality, op8_cutting_stock_packing, op9_counterfactual_toxicity, op10_differencing_shards, op11_chan_whitening, op12_wand_search, op13_batched_bpe)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Brute force in SQL for what SQL can say whole; the others depend on the method's hashes, models, plans or positions of bytes, see tests/llm."""
    return dict(ORACLES)
