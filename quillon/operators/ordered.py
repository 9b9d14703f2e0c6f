"""Operators whose result depends on a running state: token-budget packing, greedy clusters and their consolidation, tips by relevance.

A query's hits are packed in one task; clusters go in rounds over all tasks.
"""

from __future__ import annotations

from types import SimpleNamespace
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text
from ..ship import ship

#: Share of the budget that the first pass of the adaptive policy may spend, and how many leading hits are always shown.
L0_SHARE, MIN_FULL = 0.3, 3
# Least tips of a cluster that is consolidated, and clusters at a time.
CLUSTER_OF, CLUSTERS = 3, 20
#: Rows that are walked in a round of clusters.
AT_A_TIME = 4_096


def pack_greedy(hits: DataFrame, budget: int, min_full: int = MIN_FULL) -> DataFrame:
    """hits(query, rank, id, tokens) with column packed: a hit is in if it fits, or is among the first; later, smaller ones may fit still.

    A fold over the ranked hits of a query in SQL, without Python."""
    ranked = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "tokens"))).alias("hits"))

    def add(state, hit):
        fits = (state["used"] + hit["tokens"] <= budget) | (F.size(state["out"]) < min_full)
        row = F.struct(hit["rank"].alias("rank"), hit["id"].alias("id"), hit["tokens"].alias("tokens"), fits.alias("packed"))
        return F.struct((state["used"] + F.when(fits, hit["tokens"]).otherwise(0)).cast("long").alias("used"), F.concat(state["out"], F.array(row)).alias("out"))

    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<rank:{kinds['rank']},id:{kinds['id']},tokens:{kinds['tokens']},packed:boolean>>").alias("out"))
    return ranked.select("query", F.explode(F.aggregate("hits", empty, add)["out"]).alias("hit")).select("query", "hit.*")


def pack_adaptive(hits: DataFrame, budget: int, l0_share: float = L0_SHARE, min_full: int = MIN_FULL) -> DataFrame:
    """hits(query, rank, id, l0, l1, l2: tokens of each tier) with column tier: short texts within a share of the budget,
    then upgrades to l1 in order while they fit, then the leading hits to l2; null where a hit is left out."""

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank", "id"])
        cost = group[["l0", "l1", "l2"]].to_numpy()
        tier, used = np.full(len(group), -1), 0
        for k in range(len(group)):
            if used + cost[k, 0] <= budget * l0_share or k < min_full:
                tier[k], used = 0, used + cost[k, 0]
        for to, most in ((1, len(group)), (2, min_full)):
            for k in range(min(most, len(group))):
                if tier[k] >= 0 and used + cost[k, to] - cost[k, tier[k]] <= budget:
                    used, tier[k] = used + cost[k, to] - cost[k, tier[k]], to
        return pd.DataFrame({"query": group["query"], "rank": group["rank"], "id": group["id"], "tier": [None if t < 0 else f"l{t}" for t in tier]})

    ship(hits.sparkSession)
    return hits.groupBy("query").applyInPandas(walk, "query long, rank long, id long, tier string")


def _walked(rows: list, least: float) -> list:
    """The seeds among rows (topic, id, vector) in their order: those that no seed of their topic before them is near."""
    seeds: dict = {}
    for r in rows:
        x = np.asarray(r.vector, float)
        x = x / (np.linalg.norm(x) + 1e-12)
        held = seeds.setdefault(r.topic, ([], []))
        if not held[1] or (np.stack(held[1]) @ x < least).all():
            held[0].append(r.id)
            held[1].append(x)
    return [(topic, np.array(ids, np.int64), np.stack(x)) for topic, (ids, x) in seeds.items()]


def _seeds(least: float):
    """The seeds among all rows (topic, id, vector) of a task, in their order."""

    def run(batches):
        rows = [SimpleNamespace(**r) for batch in batches for r in batch.to_pylist()]
        for topic, ids, x in _walked(rows, least):
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([topic] * len(ids), pa.int64()), pa.array(ids), vectors], names=["topic", "id", "vector"])

    return run


def _taken(seeds: list) -> list:
    """Seeds as they come from tasks, by topic."""
    by: dict = {}
    for r in seeds:
        by.setdefault(r.topic, ([], []))[0].append(r.id)
        by[r.topic][1].append(np.asarray(r.vector))
    return [(topic, np.array(ids, np.int64), np.stack(x)) for topic, (ids, x) in by.items()]


def _near(seeds: list, least: float):
    """Each row with the first seed of its topic that it is near to, or null."""
    by = {topic: (ids, x) for topic, ids, x in seeds}

    def run(batches):
        for batch in batches:
            topics, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            found, none = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
            for topic in set(topics.tolist()) & by.keys():
                at = np.flatnonzero(topics == topic)
                known, centres = by[topic]
                x = np.stack([np.asarray(v, float) for v in batch.column(2).take(pa.array(at)).to_pylist()])
                near = (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)) @ centres.T >= least
                near |= ids[at][:, None] == known  # a seed is its own, also a zero vector
                found[at], none[at] = known[near.argmax(1)], ~near.any(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, mask=none)], names=["topic", "id", "vector", "seed"])

    return run


def greedy_clusters(vectors: DataFrame, least: float = 0.85, at_a_time: int = AT_A_TIME) -> DataFrame:
    """vectors(topic, id, vector) with column seed: in order of id each vector joins the first seed of its topic that it is as
    near to, by cosine, or becomes one (J21).

    The walk goes in rounds. The first `at_a_time` undecided rows by id are walked in a task, which gives seeds, all that the driver gets; a pass over all undecided rows, wherever
    they are, gives each that is near one of these its first one; the rest goes on. Seeds of earlier rounds come before those of later ones, so the result
    is that of one walk, and no topic is held in one task. Rows with a null id or vector are left out; vectors have one length."""
    ship(vectors.sparkSession)
    spark, path = vectors.sparkSession, scratch.folder(vectors.sparkSession, "clusters")
    rest = vectors.where("id is not null and vector is not null").select(F.col("topic").cast("long"), F.col("id").cast("long"), F.col("vector").cast("array<double>"))
    kinds, number = "topic long, id long, vector array<double>, seed long", 0
    while seeds := rest.orderBy("id", "topic").limit(at_a_time).repartition(1).sortWithinPartitions("id", "topic").mapInArrow(_seeds(least), "topic long, id long, vector array<double>").collect():
        marked = rest.mapInArrow(_near(_taken(seeds), least), kinds).withColumn("decided", F.col("seed").isNotNull())
        marked.write.partitionBy("decided").parquet(f"{path}/round-{number}")
        rest, number = spark.read.schema(f"{kinds}, decided boolean").parquet(f"{path}/round-{number}").where("not decided").select("topic", "id", "vector"), number + 1
    if not number:
        return spark.createDataFrame([], "topic long, id long, seed long")
    rounds = spark.read.schema(kinds).parquet(*[f"{path}/round-{k}" for k in range(number)], recursiveFileLookup=True)
    return rounds.where("seed is not null").select("topic", "id", "seed")


def consolidations(tips: DataFrame, clusters: DataFrame, least: int = CLUSTER_OF, budget: int = CLUSTERS) -> DataFrame:
    """(seed, n_tips, contrastive, agent, category, tips: their ids in order) of clusters(id, seed) of tips(id, agent, category): those of `least` tips or more, the first
    `budget` by seed. A cluster with tips of two agents is contrastive and goes to the whole fleet, else to the agent of its seed (M25)."""
    named = F.when(F.coalesce("agent", F.lit("")) != "", F.col("agent"))
    both = clusters.join(tips.select("id", named.alias("agent"), "category"), "id")
    held = both.groupBy("seed").agg(F.count("*").alias("n_tips"), (F.count_distinct("agent") >= 2).alias("contrastive"), F.max(F.when(F.col("id") == F.col("seed"), F.col("agent"))).alias("own"), F.max(F.when(F.col("id") == F.col("seed"), F.col("category"))).alias("category"), F.array_sort(F.collect_list("id")).alias("tips"))
    chosen = held.where(F.col("n_tips") >= least).orderBy("seed").limit(budget)
    return chosen.select("seed", "n_tips", "contrastive", F.when(F.col("contrastive"), "fleet").otherwise(F.coalesce("own", F.lit("curator"))).alias("agent"), "category", "tips")


def rank_tips(tips: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query, id, relevance, place) of tips(id, agent, text, context, category, created_at, archived) for queries(query, agent, text): of an agent's newest tips, ten times
    the limit but 50 at least, the first `limit` by relevance and then the newest (F35, W22). Relevance counts the query's tokens that stand anywhere in a tip, and two
    more if its context holds the query's fingerprint; without tokens the newest come first."""
    newest = Window.partitionBy("agent").orderBy(F.desc("created_at"), F.desc("id"))
    recent = tips.where("not archived").withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= max(10 * limit, 50))
    some = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    recent = recent.select("agent", "id", "created_at", F.concat_ws(" ", some("text"), some("context"), some("category")).alias("hay"), F.coalesce("context", F.lit("")).alias("context"))
    asked = queries.select("query", "agent", text.tip_tokens(F.col("text")).alias("tokens"), text.task_fingerprint(F.col("text")).alias("mark"))
    both = asked.join(recent, "agent")
    hits = F.size(F.filter("tokens", lambda t: F.contains("hay", t))) + F.when(F.contains("context", "mark"), 2).otherwise(0)
    both = both.withColumn("relevance", F.when(F.size("tokens") > 0, hits).otherwise(0).cast("double"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("relevance"), F.desc("created_at"), F.desc("id")))
    return both.withColumn("place", place).where(F.col("place") <= limit).select("query", "id", "relevance", "place")
