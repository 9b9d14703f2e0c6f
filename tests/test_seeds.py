"""What the driver gets of greedy clusters."""

from quillon.operators import ordered


def test_seeds_alone_go_to_the_driver(spark, monkeypatch):
    taken, kept = [], ordered._taken
    monkeypatch.setattr(ordered, "_taken", lambda seeds: taken.append(len(seeds)) or kept(seeds))
    rows = [(0, k, [1.0, k % 3 / 10_000] if k % 2 else [k % 3 / 10_000, 1.0]) for k in range(300)]
    got = {r.id: r.seed for r in ordered.greedy_clusters(spark.createDataFrame(rows, "topic long, id long, vector array<double>"), 0.85, 100).collect()}
    assert got == {k: k % 2 for k in range(300)} and taken == [2]
