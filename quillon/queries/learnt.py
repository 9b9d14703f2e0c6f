"""Queries over learning to rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learning, ranking


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _feedback(spark, sf_dir):
    ratings = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("rating"))
    outcomes = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failure").alias("outcome"))
    return ratings, outcomes


def j27_training_groups(spark, sf_dir):
    """What each user was shown, with the best grade that labels and orders give it."""
    shown = _table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.get_json_object("props", "$.k").cast("long").alias("id")).where("id is not null").distinct()
    return learning.training_set(shown.withColumn("features", F.array().cast("array<double>")), *_feedback(spark, sf_dir)).select("query", "id", "label")


def r17_learnt_ranking(spark, sf_dir):
    """Candidates of each passage in the order of a model that is fitted on documents' quality; see the tests for what such a model learns."""
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = items.select(F.col("item_id").alias("query"), "text").join(vectors.withColumnRenamed("id", "query"), "query", "left").withColumn("own", F.col("query"))
    lexical, near = ranking.bm25_topk(docs.select(F.col("doc_id").alias("id"), "text"), asked, 40), ranking.cosine_topk(vectors.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi"), asked, 40)
    both = ranking.rrf([lexical, near]).withColumnRenamed("score", "rrf").join(lexical.select("query", "id", F.col("score").alias("bm25")), ["query", "id"], "left").join(near.select("query", "id", F.col("score").alias("cosine")), ["query", "id"], "left")
    both = both.join(docs.select(F.col("doc_id").alias("id"), F.length("text").cast("double").alias("chars"), (F.col("n_chars") % 45).cast("double").alias("age")), "id")
    known = {"vector_score": F.col("cosine"), "bm25_score": F.col("bm25"), "rrf_score": F.col("rrf"), "importance_score": F.lit(0.5), "temporal_decay": ranking.decay(F.lit(1.0), F.col("age")), "chunk_length": F.col("chars"), "recency_days": F.col("age")}
    candidates = both.select("query", "id", F.array(*[F.coalesce(known.get(f, F.lit(0.0)), F.lit(0.0)) for f in learning.FEATURES]).alias("features")).persist()
    model = learning.fit(learning.training_set(candidates, *_feedback(spark, sf_dir)), trees=10, depth=3)
    return ranking.ranked(learning.score(candidates, model)).select("query", "id", F.round("score", 6).alias("score"), "rank")


QUERIES = {f.__name__: f for f in (j27_training_groups, r17_learnt_ranking)}
ORACLES = {
    "j27_training_groups": """with c as (select distinct user_id as query, cast(json_extract_string(props, '$.k') as bigint) as id from events), g as (select doc_id as id, case when quality = 1 then 2 else 0 end as label from labels union all select o_orderkey, case when o_orderstatus = 'F' then 2 else 0 end from orders),
      b as (select id, max(label) as label from g group by id), n as (select query from c where id is not null group by query having count(*) >= 2) select c.query, c.id, coalesce(label, 1) as label from c join n using (query) left join b using (id) where c.id is not null""",
}
