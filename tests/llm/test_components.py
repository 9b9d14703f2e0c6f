"""Connected components: parts contracted by themselves, and the rounds over them."""

import random

import numpy as np

from quillon.llm import common


def _least(edges):
    of = {}
    for a, b in edges:
        x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
        if x is not y:
            x |= y
            of.update(dict.fromkeys(y, x))
    return {(n, min(held)) for n, held in of.items()}


def _odd():
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(-50, 400)] + [(10_000, 10_000 + k) for k in range(1, 200)] + [(rng.randrange(20_000, 21_000), rng.randrange(20_000, 21_000)) for _ in range(700)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges if a != b]
    rng.shuffle(edges)
    return edges


def test_contracted():
    edges = _odd()
    u, v = common.contracted(*np.array(edges).T)
    assert set(zip(u.tolist(), v.tolist())) == {(n, c) for n, c in _least(edges) if n != c}


def test_components(spark, monkeypatch):
    """One part needs no round, so a handful of jobs; several parts, contracted in bits, give the same."""
    edges = _odd()
    links = spark.createDataFrame([*edges, (7, 7)], "a long, b long")
    spark.sparkContext.setJobGroup("one-part", "")
    assert {tuple(r) for r in common.components(links).collect()} == _least(edges)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-part")) <= 16
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(common, "EDGES_A_PART", 500)
    monkeypatch.setattr(common, "CONTRACTED", 100)
    assert {tuple(r) for r in common.components(links).collect()} == _least(edges)
    monkeypatch.setattr(common, "EDGES_A_PART", 2 * len(edges))  # one part as soon as the first contraction is done
    assert {tuple(r) for r in common.components(links.union(links.selectExpr("a", "a + 1000000"))).collect()} == _least([*edges, *((a, a + 1_000_000) for a, _ in edges)] + [(7, 1_000_007)])
    assert common.components(links.limit(0)).count() == 0
