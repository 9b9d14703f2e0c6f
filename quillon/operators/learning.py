"""Learning to rank: the training set from logged candidates and feedback, LambdaMART by histogram trees, and scores.

Features are cut into bins by quantiles. A row for each query holds its candidates' bins and labels, so pairs of candidates meet where they are read. For each
level of a tree one pass computes the queries' lambda gradients and sums them by node, feature and bin in each task; these histograms, of a size that only the
model's form decides, are added in a tree over the executors, and the driver picks the splits. Gradients are rounded to whole numbers of 2**-30, so sums
do not depend on their order and a seed gives one model.

A query's candidates are what a search returns, so a row is small. Null and missing features count as 0.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..ship import ship

# Features of a candidate, in order; grades of feedback and of candidates without any; what a model is fitted with.
FEATURES = ("vector_score", "bm25_score", "rrf_score", "hotness", "importance_score", "temporal_decay", "outcome_adjustment", "graph_hop", "mention_count", "rerank_score", "chunk_length", "recency_days")
GOOD, BAD, UNRATED, LEAST_SAMPLES = 2, 0, 1, 50
TREES, DEPTH, RATE, LEAST_IN_LEAF, RIDGE, SAMPLED = 100, 4, 0.1, 10, 1.0, 0.8
BINS = 32
_UNIT = 2.0**30


def training_set(candidates: DataFrame, ratings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """candidates(query, id, features) with their label: the best of what ratings(id, rating) and outcomes(id, outcome) say, UNRATED without any; queries with one
    candidate are left out (J27)."""
    said = ratings.select("id", F.when(F.col("rating") > 0, GOOD).otherwise(BAD).alias("label")).union(outcomes.select("id", F.when(F.col("outcome") == "success", GOOD).otherwise(BAD)))
    grades = said.groupBy("id").agg(F.max("label").alias("label"))
    many = candidates.groupBy("query").agg(F.count("*").alias("n")).where("n >= 2").select("query")
    return candidates.join(many, "query", "left_semi").join(grades, "id", "left").select("query", "id", F.coalesce("label", F.lit(UNRATED)).alias("label"), "features")


@dataclass
class Tree:
    """Nodes by number; a node's children are 2k + 1 and 2k + 2. feature is -1 at a leaf; a bin up to `cut` goes left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return at
            k = at[inner]
            at[inner] = 2 * k + 1 + (bins[inner, self.feature[k]] > self.cut[k])


@dataclass
class Model:
    edges: np.ndarray
    trees: list[Tree] = field(default_factory=list)

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, features[:, k], "left") for k, e in enumerate(self.edges)], 1).astype(np.uint8)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees:
            out += tree.value[tree.nodes(bins)]
        return out

    def text(self) -> str:
        return json.dumps({"edges": self.edges.tolist(), "trees": [[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in self.trees]})

    @classmethod
    def read(cls, text: str) -> Model:
        held = json.loads(text)
        return cls(np.array(held["edges"]), [Tree(*(np.array(x) for x in t)) for t in held["trees"]])


def gradients(labels: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lambda gradients and their second derivatives: pairs that are ordered wrongly pull at each other by what their exchange would change of NDCG."""
    gain, order = 2.0**labels - 1, np.argsort(-scores, kind="stable")
    discount = np.empty(len(labels))
    discount[order] = 1 / np.log2(np.arange(len(labels)) + 2)
    ideal = (np.sort(gain)[::-1] / np.log2(np.arange(len(labels)) + 2)).sum()
    if ideal <= 0:
        return np.zeros(len(labels)), np.zeros(len(labels))
    better = labels[:, None] > labels[None, :]
    change = np.abs((gain[:, None] - gain[None, :]) * (discount[:, None] - discount[None, :])) / ideal
    wrong = 1 / (1 + np.exp(np.clip(scores[:, None] - scores[None, :], -50, 50)))
    pull, bend = better * change * wrong, better * change * wrong * (1 - wrong)
    return pull.sum(0) - pull.sum(1), bend.sum(0) + bend.sum(1)


def _array(values, width: int) -> np.ndarray:
    return np.array([[x or 0.0 for x in (v or [])[:width]] + [0.0] * (width - len(v or [])) for v in values], float).reshape(len(values), width)


def _histograms(model: Model, tree: Tree, nodes: list[int], seed: int, sampled: float):
    """Sums of gradients, second derivatives and counts by open node, feature and bin, over a task's queries."""

    def run(batches):
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))
        width = len(model.edges)
        out = np.zeros((3, len(nodes), width, BINS), np.int64)
        for batch in batches:
            for draw, labels, raw in zip(batch.column("draw").to_pylist(), batch.column("labels"), batch.column("bins").to_pylist()):
                if np.random.default_rng([seed, draw, len(model.trees)]).random() > sampled:
                    continue
                bins = np.frombuffer(raw, np.uint8).reshape(-1, width)
                g, h = gradients(labels.values.to_numpy().astype(float), model.scores(bins))
                at = place[tree.nodes(bins)]
                live = at >= 0
                for k, values in enumerate((np.rint(g * _UNIT).astype(np.int64), np.rint(h * _UNIT).astype(np.int64), np.ones(len(g), np.int64))):
                    for f in range(width):
                        np.add.at(out[k, :, f], (at[live], bins[live, f]), values[live])
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    return run


def _split(sums: np.ndarray, columns: np.ndarray, least: int, ridge: float) -> tuple[int, int, float]:
    """(feature, cut, gain) of a node's best split; feature -1 if none is worth it. The first of equal ones."""
    g, h, n = sums[0] / _UNIT, sums[1] / _UNIT, sums[2]
    gl, hl, nl = g.cumsum(1), h.cumsum(1), n.cumsum(1)
    gr, hr, nr = gl[:, -1:] - gl, hl[:, -1:] - hl, nl[:, -1:] - nl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gl[:, -1:] ** 2 / (hl[:, -1:] + ridge)
    gain[(nl < least) | (nr < least)] = -np.inf
    gain[np.setdiff1d(np.arange(len(gain)), columns)] = -np.inf
    f, cut = np.unravel_index(int(np.argmax(np.round(gain, 9))), gain.shape)
    return (int(f), int(cut), float(gain[f, cut])) if gain[f, cut] > 1e-9 else (-1, 0, 0.0)


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, least: int = LEAST_IN_LEAF, ridge: float = RIDGE, sampled: float = SAMPLED, seed: int = 7) -> Model | None:
    """A model of rows(query, id, label, features); None for fewer than LEAST_SAMPLES rows. Rows with a null query, id or label are not learnt from."""
    ship(rows.sparkSession)
    rows = rows.where("query is not null and id is not null and label is not null and features is not null")
    n, width = rows.agg(F.count("*"), F.max(F.size("features"))).first()
    if n < LEAST_SAMPLES:
        return None
    shares = [(k + 1) / BINS for k in range(BINS - 1)]
    value = lambda k: F.coalesce(F.get("features", F.lit(k)), F.lit(0.0)).cast("double")
    found = rows.agg(*[F.percentile_approx(value(k), shares, 10_000).alias(f"q{k}") for k in range(width)]).first()
    model = Model(np.array([found[f"q{k}"] for k in range(width)]))

    def binned(batches):
        for batch in batches:
            raw = [model.bins(_array(features, width)).tobytes() for features in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["draw", "labels", "bins"])

    groups = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("id", "label", "features"))).alias("c"))
    groups = groups.select(F.pmod(F.xxhash64(F.col("query").cast("string")), F.lit(2**31)).alias("draw"), F.col("c.label").cast("array<int>").alias("labels"), F.col("c.features").cast("array<array<double>>").alias("features"))
    path = scratch.folder(rows.sparkSession, "ranked")
    groups.mapInArrow(binned, "draw long, labels array<int>, bins binary").write.option("compression", "zstd").parquet(path)
    held = rows.sparkSession.read.parquet(path)
    size = 2 ** (depth + 1) - 1
    for number in range(trees):
        columns = np.sort(np.random.default_rng([seed, number]).permutation(width)[: max(1, round(sampled * width))])
        tree, nodes = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)), [0]
        for _ in range(depth):
            parts = held.mapInArrow(_histograms(model, tree, nodes, seed, sampled), "sums binary").rdd.map(lambda r: np.frombuffer(r.sums, np.int64))
            sums = parts.treeReduce(np.add).reshape(3, len(nodes), width, BINS)
            below = []
            for k, node in enumerate(nodes):
                feature, cut, _ = _split(sums[:, k], columns, least, ridge)
                g, h, _ = sums[:, k, 0].sum(1) / _UNIT
                tree.value[node] = -rate * g / (h + ridge)
                if feature >= 0:
                    tree.feature[node], tree.cut[node] = feature, cut
                    for child, side in ((2 * node + 1, slice(0, cut + 1)), (2 * node + 2, slice(cut + 1, BINS))):
                        g, h, _ = sums[:, k, feature, side].sum(1) / _UNIT
                        tree.value[child] = -rate * g / (h + ridge)
                        below.append(child)
            nodes = below
            if not nodes:
                break
        if tree.feature[0] < 0:
            break
        model.trees.append(tree)
    return model


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """(query, id, score) of rows(query, id, features), without an exchange; without a model the first feature is the score."""
    ship(rows.sparkSession)
    rows = rows.select(F.col("query").cast("long"), F.col("id").cast("long"), F.col("features").cast("array<double>"))
    if model is None:
        return rows.select("query", "id", F.coalesce(F.get("features", F.lit(0)), F.lit(0.0)).alias("score"))

    def run(batches):
        for batch in batches:
            scores = model.scores(model.bins(_array(batch.column(2).to_pylist(), len(model.edges))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["query", "id", "score"])

    return rows.mapInArrow(run, "query long, id long, score double")
