"""Ranking, graph and life-cycle operators on small tables, against brute force or rows worked out by hand."""

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import graph, memory, ranking


def test_cosine_topk_is_exact_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    x[5] = 0
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(999, None)], "id long, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(k, v.tolist(), k) for k, v in enumerate(q)], "query long, vector array<double>, own long")
    cosine = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).T
    for most in (ranking.NUMBERS_AT_A_TIME, 16):
        monkeypatch.setattr(ranking, "NUMBERS_AT_A_TIME", most)
        got = {(r.query, r["rank"]): (r.id, r.score) for r in ranking.cosine_topk(vectors, asked, 6).collect()}
        for k in range(7):
            own = [i for i in np.argsort(-cosine[k]).tolist() if i not in (k, 5)][:6]
            assert [got[k, n + 1][0] for n in range(6)] == own and all(abs(got[k, n + 1][1] - cosine[k, i]) < 1e-9 for n, i in enumerate(own))
    assert ranking.cosine_topk(vectors, asked.limit(0), 3).count() == ranking.bm25_topk(vectors.selectExpr("id", "'' as text"), asked.selectExpr("query", "'a' as text"), 3).count() == 0


def test_bm25_in_blocks_of_queries(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"w{k % 3} w{k % 5} x" + " x" * (k % 4)) for k in range(40)] + [(99, None)], "id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "W4 x"), (3, "absent"), (4, None)], "query long, text string")
    whole = sorted(map(tuple, ranking.bm25_topk(docs, asked, 5).collect()))
    monkeypatch.setattr(ranking, "TERMS_AT_A_TIME", 1)
    assert sorted(map(tuple, ranking.bm25_topk(docs.repartition(7), asked, 5).collect())) == whole and {h[0] for h in whole} == {1, 2}


def hits(spark, rows):
    return spark.createDataFrame(rows, "query long, id long, score double, rank long")


def test_fusion_with_one_kind_of_hits(spark):
    vector, lexical = hits(spark, [(1, 1, 0.9, 1), (1, 2, 0.1, 2), (2, 5, 0.4, 1)]), hits(spark, [(1, 2, 7.0, 1), (3, 9, 2.0, 1)])
    got = {(r.query, r.id): round(r.score, 6) for r in ranking.fuse(vector, lexical).collect()}
    assert got == {(1, 1): 1.4, (1, 2): 0.6, (2, 5): 0.4, (3, 9): 0.6}


def test_merge_keeps_the_first(spark):
    got = ranking.merge_keep_top(hits(spark, [(1, 1, 0.5, 1), (1, 2, 0.4, 2)]), hits(spark, [(1, 2, 9.0, 1), (1, 3, 0.9, 2), (1, 4, 0.1, 3)]), 1, F.lit(0.3)).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(1, 0.5), (3, 0.9), (2, 0.4), (4, 0.3)]


def test_search_path(spark):
    docs = spark.createDataFrame([(k, f"text {k} " + ("needle " * 3 if k == 9 else "plain words"), f"agent{k % 2}", None if k == 3 else 10 * k, 0.5) for k in range(12)], "id long, text string, agent string, age_days int, importance double")
    vectors = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(12)], "id long, vector array<double>")
    asked = spark.createDataFrame([(1, "needle", [1.0, 0.0], None)], "query long, text string, vector array<double>, own long")
    got = ranking.search(docs, vectors, asked, 20, 8).orderBy("place").collect()
    assert got[0].id == 0 and [r.id for r in got if r.rescued] == [9]
    assert [r.place for r in got] == list(range(1, len(got) + 1)) and ranking.search(docs, vectors, asked, 3, 8).count() == 3


def test_mentions(spark):
    names = [(1, "Argo CD", 50), (2, "cargo", 5), (3, "argo", 60), (4, "hot cache", 30), (5, "cache", 25), (6, "the", 1), (7, "db", 1)]
    entities = spark.createDataFrame(names, "id long, name string, mentions long")
    asked = spark.createDataFrame([(1, "is Argo CD up"), (2, "hot cache"), (3, "the db"), (4, "zebra"), (5, None)], "query long, text string")
    got = {}
    for r in graph.mentions(asked, entities).collect():
        got.setdefault(r.query, set()).add(r.id)
    assert got == {1: {1, 2, 3}, 2: {4, 5}, 3: {7}}  # a single word with many mentions must be the name


def test_expansion_visits_each_once(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(6)] + [(0, 2), (2, 0)], "a long, b long")
    seeds = spark.createDataFrame([(1, 0), (2, 6), (2, 5)], "query long, id long")
    got = sorted((r.query, r.id, r.hop) for r in graph.expand(edges, seeds, 2).collect())
    assert got == [(1, 0, 0), (1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 3, 2), (2, 4, 1), (2, 5, 0), (2, 6, 0)]
    assert [r.id for r in graph.expand(edges, seeds.where("query = 1"), 2, 3).orderBy("hop", "id").collect()] == [0, 1, 2]


def test_replay(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8), (4, 77)], "id long, parent long")
    leaves = spark.createDataFrame([(3,), (8,), (4,), (100,)], "leaf long")
    got = {}
    for r in graph.replay(nodes, leaves, 5).collect():
        got.setdefault(r.leaf, []).append((r.step, r.id))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {3: [(0, 1), (1, 2), (2, 3)], 8: [(None, None)], 4: [(0, 4)]}
    assert [r.id for r in graph.replay(nodes, leaves.where("leaf = 3"), 2).orderBy("step").collect()] == [2, 3]


def test_supersede(spark):
    rows = [(1, 7, "the port is 80"), (2, 7, "the port is 81"), (3, 7, "colour blue"), (4, 8, "the port is 80"), (5, 7, "port is the 90 now"), (6, 7, None)]
    got = {r.id: r.superseded_by for r in memory.supersede(spark.createDataFrame(rows, "id long, entity long, fact string")).collect()}
    assert got == {1: 2, 2: 5, 3: None, 4: None, 5: None, 6: None}


def test_resolutions(spark):
    rows = [(1, 1, 2, "a b enabled thing", "a b disabled thing", 1, 2, "enabled/disabled"), (1, 3, 4, "same text here", "same text here too", 1, 1, "near_duplicate"), (1, 5, 6, "x enabled", "y disabled", 3, 3, "enabled/disabled"), (1, 7, 8, "one two", "other words", 1, 2, None)]
    got = {r.a: (r.action, r.winner, r.loser, r.merged) for r in memory.resolutions(spark.createDataFrame(rows, "entity long, a long, b long, text_a string, text_b string, at_a long, at_b long, trigger string")).collect()}
    assert got == {1: ("supersede", 2, 1, None), 3: ("merge", None, None, "same text here too"), 5: ("keep_both", None, None, None), 7: ("keep_both", None, None, None)}


def test_outbox_cycles_until_dead(spark):
    rows = spark.createDataFrame([(1, "pending", 0, None, 1), (2, "pending", 0, None, 2), (3, "processing", 1, 0, 0)], "id long, status string, tries int, last long, created long")
    box = rows.selectExpr("id", "status", "tries", "timestamp_seconds(last) as last_attempt", "timestamp_seconds(created) as created_at")
    failing = spark.createDataFrame([(2,), (3,)], "id long")
    for cycle in range(1, 6):
        box = spark.createDataFrame(memory.drain_cycle(box, failing, F.timestamp_seconds(F.lit(1000 * cycle))).collect(), box.schema)
    got = {r.id: (r.status, r.tries) for r in box.collect()}
    assert got == {1: ("applied", 1 - 1), 2: ("dead", 5), 3: ("dead", 5)}


def test_upsert_and_cascade(spark):
    old = spark.createDataFrame([(1, 3, 10, "durable"), (2, 1, 5, "standard")], "id long, mention_count long, last_seen long, retention string")
    seen = spark.createDataFrame([(1, 7, "standard"), (1, 12, "permanent"), (3, 1, "ephemeral")], "id long, at long, retention string")
    got = {r.id: tuple(r)[1:] for r in memory.upsert_entities(old, seen).collect()}
    assert got == {1: (5, 12, "permanent"), 2: (1, 5, "standard"), 3: (1, 1, "ephemeral")}
    points = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "id long, parent long")
    words = spark.createDataFrame([(1,), (2,), (10,), (11,)], "memory long")
    left = memory.cascade_delete({"points": (points, "parent"), "words": (words, "memory")}, spark.createDataFrame([(1,)], "id long"), ("points", "id"))
    assert sorted(r.id for r in left["points"].collect()) == [11, 12] and sorted(r.memory for r in left["words"].collect()) == [2, 11]


def test_bootstrap_holds_the_mean(spark):
    rng = np.random.default_rng(3)
    rows = [("many", k, float(v)) for k, v in enumerate(rng.normal(5, 1, 400))] + [("few", k, 1.0) for k in range(5)]
    got = {r.key: r for r in memory.bootstrap(spark.createDataFrame(rows, "key string, id long, value double"), 300).collect()}
    m = got["many"]
    assert m.n == 400 and m.low < m.mean < m.high and 0.12 < m.high - m.low < 0.28  # 2 x 1.96 / 20
    assert got["few"].mean == 1.0 and got["few"].low is None
