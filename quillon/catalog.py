"""All queries of the package by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog as own
from .operators import ranking
from .plans import graph, lifecycle, observability, records, retrieval
from .plans.dialect import duck_text, spark_frame, tables_of, with_frames
from .queries import learnt, memory, rules, searches, texts, tips

_TEXTS = observability.QUERIES | retrieval.QUERIES | graph.QUERIES | records.QUERIES | lifecycle.QUERIES
_MODULES = (own, texts, memory, rules, searches, tips, learnt)


#: Best hits of a query that queries over shared rankings look at.
HITS = 64
#: Parts that the checking SQL spells out, and the frames that stand for them here.
_SHARED = {
    retrieval.BM25: f"""{retrieval.TERMS}, lexical as (select query as item_id, id as doc_id, score, rank as rn from {{_lexical}}),
      h as (select distinct doc_id from lexical where rn <= 10), w as (select h.doc_id, EXPLODE(TOKENS(text)) as term from h join {{documents}} d on h.doc_id = d.doc_id), tf as (select distinct doc_id, term from w)""",
    retrieval.COSINE: "vectors as (select query as item_id, id as doc_id, score, rank as rn from {_vectors})",
}


def _lexical(frames: dict[str, DataFrame]) -> DataFrame:
    asked = frames["benchmark"].select(F.col("item_id").alias("query"), "text")
    return ranking.bm25_topk(frames["documents"].select(F.col("doc_id").alias("id"), "text"), asked, HITS)


def _vectors(frames: dict[str, DataFrame]) -> DataFrame:
    vectors = frames["embeddings"].select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = frames["benchmark"].select(F.col("item_id").alias("query"), F.col("item_id").alias("own")).join(vectors, F.col("own") == F.col("id"))
    return ranking.cosine_topk(vectors, asked.select("query", "vector", "own"), HITS)


def framed(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query text over the tables of a folder; rankings in it come from the ranking operators."""
    spoken = with_frames(text, _SHARED)
    if "bm25 as (" in spoken or "cos as (" in spoken:  # else it would be run as it is spelled out for the checking SQL
        raise ValueError(f"a ranking is spelled out in other words than the shared part: {text[:80]}")
    needs = {"_lexical": (_lexical, ("benchmark", "documents")), "_vectors": (_vectors, ("benchmark", "embeddings"))}
    rankings = {name: of for name, of in needs.items() if f"{{{name}}}" in spoken}
    names = {*tables_of(spoken), *(t for _, tables in rankings.values() for t in tables)} - set(needs)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}
    frames |= {name: of(frames) for name, (of, _) in rankings.items()}
    return spark_frame(spark, spoken, frames)


def _planned(text: str):
    return lambda spark, sf_dir: framed(spark, sf_dir, text)


def queries() -> dict:
    out = {name: _planned(text) for name, text in _TEXTS.items()}
    for module in _MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: duck_text(text) for name, text in (_TEXTS | graph.ORACLES).items()}
    for module in _MODULES:
        out |= module.ORACLES
    return out
