"""Queries over clusters of vectors and tips, with SQL written by hand from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import ordered

#: Vectors of the tables are far from each other; clusters of tips are told from here on.
LIKE = 0.35


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark, sf_dir, topic):
    return _table(spark, sf_dir, "embeddings").select(topic.cast("long").alias("topic"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def j21_clusters_by_label(spark, sf_dir):
    return ordered.greedy_clusters(_vectors(spark, sf_dir, F.col("label")), LIKE)


def m25_consolidations(spark, sf_dir):
    """All vectors as tips, told apart by agent and category."""
    clusters = ordered.greedy_clusters(_vectors(spark, sf_dir, F.lit(0)), LIKE)
    tips = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") > 0, F.concat(F.lit("agent"), F.col("label") % 2)).alias("agent"), F.col("label").cast("string").alias("category"))
    return ordered.consolidations(tips, clusters).withColumn("tips", F.array_join("tips", ","))


def w22_tip_ranking(spark, sf_dir):
    """Documents as tips of their sources, for each passage as a task of one."""
    docs = _table(spark, sf_dir, "documents")
    tips = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("agent"), "text", text.task_fingerprint(F.col("text")).alias("context"), F.col("lang").alias("category"), F.col("doc_id").alias("created_at"), F.coalesce(F.col("n_chars") > 15000, F.lit(False)).alias("archived"))
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("agent"), "text")
    return ordered.rank_tips(tips, asked)


QUERIES = {f.__name__: f for f in (j21_clusters_by_label, m25_consolidations, w22_tip_ranking)}

_DOT = "list_dot_product(s.e, v.e)"


def _walk(topic: str) -> str:
    """CTEs that end in clusters(topic, id, seed), vector by vector in order of id."""
    return f"""v as (select cast({topic} as bigint) as topic, vec_id as id, list_transform(cast(embedding as double[]), lambda x: x / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[])))) as e, row_number() over (partition by {topic} order by vec_id) as k from embeddings),
      w as (select topic, cast(0 as bigint) as k, cast([] as struct(id bigint, e double[])[]) as seeds, cast(null as bigint) as id, cast(null as bigint) as seed from (select distinct topic from v)
        union all select topic, k, case when seed is null then list_append(seeds, {{'id': id, 'e': e}}) else seeds end, id, coalesce(seed, id)
          from (select w.topic, v.k, w.seeds, v.id, v.e, list_filter(w.seeds, lambda s: {_DOT} >= {LIKE})[1].id as seed from w join v on v.topic = w.topic and v.k = w.k + 1)),
      clusters as (select topic, id, seed from w where id is not null)"""


_STOPS = ", ".join(f"'{w}'" for w in fixed.TIP_STOP_WORDS)
_MARK = "substr(sha256(trim(regexp_replace(lower({0}), '[\\x09-\\x0D\\x1C-\\x20]+', ' ', 'g'), ' ')), 1, 16)"
ORACLES = {
    "j21_clusters_by_label": f"with recursive {_walk('label')} select * from clusters",
    "m25_consolidations": f"""with recursive {_walk('0')}, t as (select vec_id as id, case when label > 0 then 'agent' || (label % 2) end as agent, cast(label as varchar) as category from embeddings),
      h as (select seed, count(*) as n_tips, count(distinct agent) >= 2 as contrastive, max(agent) filter (where id = seed) as own, max(category) filter (where id = seed) as category, string_agg(id, ',' order by id) as tips from clusters join t using (id) group by seed)
      select seed, n_tips, contrastive, case when contrastive then 'fleet' else coalesce(own, 'curator') end as agent, category, tips from h where n_tips >= 3 order by seed limit 20""",
    "w22_tip_ranking": f"""with t as (select doc_id as id, source as agent, {_MARK.format("coalesce(text, '')")} as context, lower(coalesce(text, '')) || ' ' || {_MARK.format("coalesce(text, '')")} || ' ' || lower(coalesce(lang, '')) as hay, row_number() over (partition by source order by doc_id desc) as nth from documents where not coalesce(n_chars > 15000, false)),
      q as (select item_id as query, 'src' || (item_id % 20) as agent, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{{2,}}'), lambda x: x not in ({_STOPS})) as ts, {_MARK.format("coalesce(text, '')")} as mark from benchmark),
      s as (select query, id, case when len(ts) = 0 then 0 else len(list_filter(ts, lambda x: contains(hay, x))) + case when contains(context, mark) then 2 else 0 end end as relevance from q join t using (agent) where nth <= 100),
      r as (select *, row_number() over (partition by query order by relevance desc, id desc) as place from s) select query, id, cast(relevance as double) as relevance, place from r where place <= 10""",
}
