"""Approximate nearest vectors: lists around centres, of which a query reads the nearest few.

Centres are fitted by spherical k-means on a bounded sample, the rows with the least hashes of their ids; every row is in the list of its nearest centre.
The table is sorted by list, so a search reads the probed lists' pages. With all lists probed the result is exact.

Vectors have one length; a null or zero vector is in no list. What is broadcast is the centres (lists x dimensions) and, in blocks, the queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from ..sources.commits import Commits
from . import ranking

#: Lists and, of these, those that a query reads: vectors without any grouping, as the tables have, need many (recall 0.92 at 10,000 rows of 64 numbers).
LISTS, PROBES = 256, 112
#: Rows that centres are fitted on at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 12
_KINDS = "list int, id long, vector array<float>"


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def centres(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centres of unit vectors; an empty list begins anew at a row that is far from its centre."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[: min(lists, len(sample))]]
    for _ in range(rounds):
        near = sample @ c.T
        at = near.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        empty = np.flatnonzero(np.bincount(at, minlength=len(c)) == 0)
        sums[empty] = sample[np.argsort(near.max(1), kind="stable")[: len(empty)]]
        c = _units(sums)
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


class VectorIndex:
    """A table of lists at a path, with its centres."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.commits = spark, Commits(spark, path)
        self.centres = np.array(self.commits.state()["note"].get("centres", []))

    @classmethod
    def build(cls, rows: DataFrame, path: str, lists: int = LISTS, sample: int = SAMPLE) -> VectorIndex:
        index = cls(rows.sparkSession, path)
        some = _sound(rows).orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
        index.centres = centres(_units(np.array([r.vector for r in some])), lists) if some else np.zeros((0, 0))
        index.add(rows)
        return index

    def add(self, rows: DataFrame) -> int:
        """Rows(id, vector) put in the lists."""
        c = self.centres

        def run(batches):
            for batch in batches:
                near = (_units(_matrix(batch.column(1))) @ c.T).argmax(1) if len(c) and batch.num_rows else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column(0), batch.column(1).cast(pa.list_(pa.float32()))], names=["list", "id", "vector"])

        ship(self.spark)
        listed = _sound(rows).mapInArrow(run, _KINDS)
        return self.commits.change(lambda base: ({"lists": listed.sortWithinPartitions("list")}, {"centres": c.tolist()}))

    def _probed(self, queries: list, probes: int) -> list[np.ndarray]:
        """For each list the numbers of the queries that read it."""
        near = np.argsort(-_units(np.array([r.vector for r in queries], float)) @ self.centres.T, axis=1, kind="stable")[:, :probes]
        return [np.flatnonzero((near == k).any(1)) for k in range(len(self.centres))]

    def search(self, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
        """(query, id, score, rank) by cosine of queries(query, vector, own: an id that is no hit, or null), from the `probes` nearest lists of each."""
        asked = queries.where(F.col("vector").isNotNull()).select(F.col("query").cast("long"), F.col("vector").cast("array<double>"), F.coalesce(F.col("own").cast("long"), F.lit(-(2**63))).alias("own"))
        out = []
        for block in ranking._blocks(asked.toLocalIterator(), lambda r: len(r.vector), ranking.NUMBERS_AT_A_TIME) if len(self.centres) else ():
            of_list = self._probed(block, probes)
            matrix, own = _units(np.array([r.vector for r in block])), np.array([r.own for r in block])
            scored = _scored(of_list, matrix, own, np.array([r.query for r in block]), k)
            wanted = [i for i, of in enumerate(of_list) if len(of)]
            out.append(self.commits.read("lists").where(F.col("list").isin(wanted)).select("list", "id", "vector").mapInArrow(scored, ranking._HIT_KINDS))
        return ranking.ranked(ranking._union(out, self.spark.createDataFrame([], ranking._HIT_KINDS)), k)

    def compared(self, queries: DataFrame, probes: int = PROBES) -> int:
        """Pairs of a query and a row that a search compares."""
        of_list = self._probed(queries.collect(), probes)
        sizes = {r["list"]: r["count"] for r in self.commits.read("lists").groupBy("list").count().collect()}
        return sum(len(of) * sizes.get(k, 0) for k, of in enumerate(of_list))


def _sound(rows: DataFrame) -> DataFrame:
    vector = F.col("vector").cast("array<double>")
    length = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    return rows.where("id is not null").select(F.col("id").cast("long").alias("id"), vector.alias("vector")).where(F.coalesce(length > 0, F.lit(False)))


def _scored(of_list: list[np.ndarray], matrix: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int):
    def run(batches):
        top = ranking.Top(queries, k)
        for batch in batches:
            lists, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = _units(_matrix(batch.column(2))) if batch.num_rows else np.zeros((0, matrix.shape[1]))
            for number in np.unique(lists):
                at, asked = np.flatnonzero(lists == number), of_list[number]
                if len(asked):
                    top.extend(asked, ids[at], matrix[asked] @ x[at].T, own[asked][:, None] != ids[at])
        query, found, scores = top.columns()
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found, pa.int64()), pa.array(scores)], schema=ranking._HITS)

    return run
