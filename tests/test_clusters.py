"""Greedy clusters in rounds against one walk, consolidations, tips by relevance, and the vector index against exact search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import scratch
from quillon.operators import ordered, ranking, vectors


def one_walk(rows, least):
    out, seeds = {}, {}
    for topic, id_, v in sorted(rows, key=lambda r: r[1]):
        x = np.array(v, float) / (np.linalg.norm(v) + 1e-12)
        near = [i for i, y in seeds.setdefault(topic, []) if y @ x >= least]
        out[topic, id_] = near[0] if near else id_
        if not near:
            seeds[topic].append((id_, x))
    return out


@pytest.mark.parametrize("at_a_time", [1, 7, 4096])
def test_clusters_in_rounds(spark, at_a_time):
    rng = random.Random(2)
    n = 12 if at_a_time == 1 else 90
    rows = [(rng.choice((1, 2)), i, [rng.gauss(0, 1) for _ in range(3)]) for i in rng.sample(range(1000), n)]
    rows += [(1, 2000, [0.0, 0.0, 0.0]), (1, 2001, [0.0, 0.0, 0.0]), (2, 2002, rows[0][2])]
    df = spark.createDataFrame([*rows, (1, None, [1.0, 0.0, 0.0]), (1, 3000, None)], "topic long, id long, vector array<double>").repartition(3)
    got = {(r.topic, r.id): r.seed for r in ordered.greedy_clusters(df, 0.8, at_a_time).collect()}
    assert got == one_walk(rows, 0.8)
    assert ordered.greedy_clusters(df.limit(0)).count() == 0


def test_consolidations(spark):
    clusters = spark.createDataFrame([(1, 1), (2, 1), (5, 1), (3, 3), (4, 3), (6, 3), (7, 7)], "id long, seed long")
    tips = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (5, None, "y"), (3, "", "z"), (4, "c", "z"), (6, "c", "z"), (7, "a", "x")], "id long, agent string, category string")
    got = [tuple(r) for r in ordered.consolidations(tips, clusters).orderBy("seed").collect()]
    assert got == [(1, 3, True, "fleet", "x", [1, 2, 5]), (3, 3, False, "curator", "z", [3, 4, 6])]
    assert ordered.consolidations(tips, clusters, 2, 1).count() == 1


def test_tips(spark):
    tips = spark.createDataFrame([(1, "a", "restart the pod", None, "ops", 5, False), (2, "a", "Check DNS", "deploys", "net", 9, False), (3, "a", "old pod", None, "ops", 1, True), (4, "b", "pod", None, "ops", 1, False)], "id long, agent string, text string, context string, category string, created_at long, archived boolean")
    asked = spark.createDataFrame([(1, "a", "Pod restart for ops"), (2, "a", "the"), (3, "a", None), (4, "c", "pod")], "query long, agent string, text string")
    got = {(r.query, r.id): (r.relevance, r.place) for r in ordered.rank_tips(tips, asked).collect()}
    assert got == {(1, 1): (3.0, 1), (1, 2): (0.0, 2), (2, 2): (0.0, 1), (2, 1): (0.0, 2), (3, 2): (0.0, 1), (3, 1): (0.0, 2)}


def test_vector_index_recall(spark):
    """A tenth to a third of the comparisons, nine of ten neighbours; a changed table; odd rows."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 3000)] + 0.9 * rng.normal(size=(3000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [0.0] * 24), (5001, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    index = vectors.VectorIndex.build(df, scratch.folder(spark, "vectors"), lists=48, sample=2000)
    asked = df.where("id % 100 = 0 and id < 3000").select(F.col("id").alias("query"), "vector", F.col("id").alias("own"))
    exact = {(r.query, r.id): round(r.score, 6) for r in ranking.cosine_topk(df, asked, 10).collect()}
    found = index.search(asked, 10, probes=8)
    got = {(r.query, r.id): round(r.score, 6) for r in found.collect()}
    assert len(got.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(exact[k] == s for k, s in got.items() if k in exact)
    assert index.compared(asked, probes=8) < 0.35 * 30 * 3000
    assert {(r.query, r.id): round(r.score, 6) for r in index.search(asked, 10, probes=48).collect()} == exact  # all lists: exact
    near = spark.createDataFrame([(9000, rows[0][1])], "id long, vector array<double>")
    index.add(near)
    assert index.search(asked.where("query = 0"), 1, probes=4).first().id == 9000
    assert index.search(asked.limit(0), 5).count() == 0


def test_vector_query_recall(spark, small):
    """The registered query finds nine of ten of the nearest rows of the table."""
    from quillon import catalog

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = set()
    for k, (i, _) in enumerate(rows):
        if i % 100 == 0:
            near = [int(j) for j in np.argsort(-(x @ x[k]), kind="stable") if j != k][:10]
            exact |= {(i, rows[j][0]) for j in near}
    got = {(r.query, r.id) for r in catalog.queries()["r1_vector_index"](spark, small).collect()}
    assert len(got & exact) >= 0.9 * len(exact)
