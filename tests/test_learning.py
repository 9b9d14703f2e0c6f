"""LambdaMART: better than the lexical order on queries it has not seen, one model for a seed, gradients by definition."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import learning


def ndcg(ranked):
    gain = lambda labels: sum((2**y - 1) / math.log2(k + 2) for k, y in enumerate(labels))
    best = gain(sorted(ranked, reverse=True))
    return gain(ranked) / best if best else None


def mean_ndcg(rows, key):
    by = {}
    for q, i, y, x in rows:
        by.setdefault(q, []).append((-key(q, i, x), i, y))
    return float(np.mean([v for v in (ndcg([y for _, _, y in sorted(c)]) for c in by.values()) if v is not None]))


def made(queries, seed):
    """What is relevant depends on two features together, and on the lexical score only a little."""
    rng = random.Random(seed)
    out = []
    for q in queries:
        for i in range(12):
            x = [rng.random(), rng.random() * 9, rng.random(), rng.random()]
            worth = 2 * (x[0] > 0.6) * (x[2] > 0.4) + 0.15 * x[1] + rng.gauss(0, 0.3)
            out.append((q, q * 100 + i, 2 if worth > 2 else 1 if worth > 1 else 0, x))
    return out


def test_learns_an_order(spark):
    kinds = "query long, id long, label int, features array<double>"
    train, held = made(range(60), 1), made(range(100, 130), 2)
    df = spark.createDataFrame([*train, (None, 1, 1, [1.0] * 4), (5, None, 1, [1.0] * 4), (5, 9, None, [1.0] * 4)], kinds)
    model = learning.fit(df.repartition(3), trees=12, depth=3)
    scores = {(r.query, r.id): r.score for r in learning.score(spark.createDataFrame(held, kinds), model).collect()}
    learnt, lexical = mean_ndcg(held, lambda q, i, x: scores[q, i]), mean_ndcg(held, lambda q, i, x: x[1])
    assert learnt > lexical + 0.05
    again = learning.fit(df.repartition(7), trees=2, depth=3)  # dealt otherwise: the same trees
    few = learning.Model.read(model.text())
    few.trees = few.trees[:2]
    assert again.text() == few.text()
    assert learning.fit(df.limit(10)) is None
    assert [r.score for r in learning.score(spark.createDataFrame([(1, 2, [7.0]), (1, 3, None)], "query long, id long, features array<double>"), None).orderBy("id").collect()] == [7.0, 0.0]
    assert learning.score(spark.createDataFrame([(1, 2, None)], "query long, id long, features array<double>"), model).count() == 1


def test_gradients():
    labels, scores = np.array([0.0, 2.0, 1.0]), np.array([3.0, 1.0, 2.0])
    g, h = learning.gradients(labels, scores)
    place = {0: 1, 2: 2, 1: 3}
    ideal = 3 / math.log2(2) + 1 / math.log2(3)
    want = [0.0] * 3
    for a, b in ((1, 0), (1, 2), (2, 0)):
        change = abs((2 ** labels[a] - 2 ** labels[b]) * (1 / math.log2(1 + place[a]) - 1 / math.log2(1 + place[b]))) / ideal
        pull = change / (1 + math.exp(scores[a] - scores[b]))
        want[a] -= pull
        want[b] += pull
    assert np.allclose(g, want) and (h > 0).all() and not learning.gradients(np.zeros(3), scores)[0].any()


def test_training_set(spark):
    found = spark.createDataFrame([(1, 10, [1.0]), (1, 11, [2.0]), (1, 12, [3.0]), (2, 10, [4.0])], "query long, id long, features array<double>")
    ratings, outcomes = spark.createDataFrame([(10, -1), (11, 1), (11, -1)], "id long, rating int"), spark.createDataFrame([(10, "success")], "id long, outcome string")
    got = {(r.query, r.id): r.label for r in learning.training_set(found, ratings, outcomes).collect()}
    assert got == {(1, 10): 2, (1, 11): 2, (1, 12): 1}
    assert learning.training_set(found, ratings, outcomes.where(F.lit(False))).where("id = 10").first().label == 0
