"""Queries over the operators that keep a running state, and over sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import retrieval
from ..plans.dialect import duck_text
from ..sources import ndjson
from ..streaming import outbox
from . import ordered

_HITS = f"""with {retrieval.BM25} select item_id as query, rn as rank, l.doc_id as id, greatest(1, cast(floor(length(text) / 4) as bigint)) as tokens
  from lexical l join {{documents}} d on l.doc_id = d.doc_id where rn <= 20"""
BUDGET = 2000


def _read(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..catalog import framed

    hits = framed(spark, sf_dir, _HITS)
    return hits.select(F.col("query").cast("long"), F.col("rank").cast("long"), F.col("id").cast("long"), F.col("tokens").cast("long"))


def w6_pack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.pack_greedy(_hits(spark, sf_dir), BUDGET)


def w7_pack_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    return ordered.pack_adaptive(hits.select("query", "rank", "id", F.least(F.lit(100), "tokens").alias("l0"), F.least(F.lit(500), "tokens").alias("l1"), F.col("tokens").alias("l2")), BUDGET)


def j21_greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")["embeddings"]
    return ordered.greedy_clusters(vectors.select(F.col("label").cast("long").alias("topic"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


def s13_ndjson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")["documents"]
    return ndjson.parsed(ndjson.lines(docs.select("doc_id", "lang", "source", "n_chars")), "doc_id long, lang string, source string, n_chars long").drop("_corrupt_record")


def t1_outbox_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.settled(outbox.from_events(_read(spark, sf_dir, "events")["events"]))


QUERIES = {f.__name__: f for f in (w6_pack_greedy, w7_pack_adaptive, j21_greedy_clusters, s13_ndjson_round_trip, t1_outbox_drain)}

_FOLD = f"""with recursive hits as ({_HITS}), walk as (select query, cast(1 as bigint) as rank, id, tokens, true as packed, tokens as used from hits where rank = 1
  union all select h.query, h.rank, h.id, h.tokens, used + h.tokens <= {BUDGET} or h.rank <= {ordered.MIN_FULL}, used + case when used + h.tokens <= {BUDGET} or h.rank <= {ordered.MIN_FULL} then h.tokens else 0 end
  from walk w join hits h on h.query = w.query and h.rank = w.rank + 1) select query, rank, id, tokens, packed from walk"""
ORACLES = {
    "w6_pack_greedy": duck_text(_FOLD),
    "s13_ndjson_round_trip": "select doc_id, lang, source, n_chars from documents",
    "t1_outbox_drain": duck_text(outbox.SETTLED_SQL),
}
