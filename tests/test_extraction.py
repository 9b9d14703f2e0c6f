"""Aliases that end at one entity, what an extraction adds, searches by alias."""

import random

from pyspark.sql import functions as F

from quillon.operators import graph


def ends(pairs):
    """By definition: groups of names that aliases connect, each with its least root, or its least name."""
    names = {n for p in pairs for n in p}
    group = {n: {n} for n in names}
    for a, b in pairs:
        both = group[a] | group[b]
        for n in both:
            group[n] = both
    aliased = {a for a, b in pairs if a != b}
    return {n: min(group[n] - aliased or group[n]) for n in names}


def test_chains_end_at_one_entity(spark):
    rng = random.Random(6)
    pairs = [(f"c{k:03}", f"c{k + 1:03}") for k in range(70)]  # a long chain
    pairs += [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("x", "y"), ("x", "z"), ("w", "w"), ("w", "v")]
    pairs += [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)]
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "name string, alias_of string")
    got = {r.name: r.entity for r in graph.canonical(df).collect()}
    assert got == ends(pairs) and got["c000"] == "c070" and got["r3"] == "r1" and got["x"] == "y"
    assert graph.canonical(df.limit(0)).count() == 0


def test_extraction(spark):
    entities = spark.createDataFrame([("Atlas", "Service", 1), (" atlas ", "tool", 3), ("", "x", 1), ("Bo", None, 2)], "name string, kind string, s long").selectExpr("name", "kind", "timestamp_seconds(s) as at")
    facts = spark.createDataFrame([("The Atlas", "is up", "notes/2024-05-01.md", None), ("Bo", "left", "a.md", "2023-01-01"), ("Bo", " ", "a.md", None), ("New", "said", "a.md", "")], "name string, fact string, file string, valid_from string")
    relations = spark.createDataFrame([("bo", "the atlas", "owns", 9), ("Bo", "ATLAS", "owns", 4), ("Cy", "", "owns", 4)], "source string, target string, kind string, s long").selectExpr("source", "target", "kind", "timestamp_seconds(s) as at")
    aliases = spark.createDataFrame([("The Atlas", "Project Atlas"), ("Project Atlas", "atlas")], "name string, alias_of string")
    own, said, met = graph.extracted(entities, facts, relations, aliases)
    got = {r.name: (r.mentions, r.retention, r.last_seen.timestamp() if r.last_seen else None) for r in own.withColumn("last_seen", F.col("last_seen")).collect()}
    assert {n: x[:2] for n, x in got.items()} == {"atlas": (5, "durable"), "bo": (4, "standard"), "new": (1, "standard")}
    assert sorted((r.name, r.fact, r.retention, r.valid_from) for r in said.collect()) == [("atlas", "is up", "durable", "2024-05-01"), ("bo", "left", "standard", "2023-01-01"), ("new", "said", "standard", None)]
    assert [tuple(r) for r in met.collect()] == [("bo", "atlas", "owns", 2, 1.0)]


def test_search_by_alias(spark):
    entities = spark.createDataFrame([("Atlas", ["big map", "globe"], 5), ("Atlantis", None, 9), ("Cy", ["the Atlas man"], 1)], "name string, aliases array<string>, mentions long")
    asked = spark.createDataFrame([(1, "atla"), (2, "GLOBE!"), (3, " "), (4, "none")], "query long, text string")
    assert sorted((r.query, r.name, r.place) for r in graph.find_entities(entities, asked).collect()) == [(1, "Atlantis", 1), (1, "Atlas", 2), (1, "Cy", 3), (2, "Atlas", 1)]
    assert graph.find_entities(entities, asked, 1).where("query = 1").first().name == "Atlantis"
