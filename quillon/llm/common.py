"""Shared plumbing: scratch tables in the shared folder, iterative components, string hashing in numpy."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..ship import ship

#: A word, as Java, RE2 and Python read it: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_U = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt over all cores where they come in fewer parts, as a small table in one file does."""
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if 2 * docs.rdd.getNumPartitions() < cores else docs


def map_arrow(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """mapInArrow with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors. A machine-local folder is used only where the cluster names none, as in tests."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/quillon-{spark.sparkContext.applicationId}"


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and an executor's loss costs nothing."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete scratch tables whose rows are no longer read by anything."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: Edges that one part of a round's table holds, both ways; and edges that a task contracts at a time.
EDGES_A_PART, CONTRACTED = 100_000, 200_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (u, v) connect: each node but the least of its component with that one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def _contract(batches):
    held, size = [], 0

    def done():
        columns = contracted(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["u", "v"])

    for batch in batches:
        for k in range(0, batch.num_rows, CONTRACTED):
            part = batch.slice(k, CONTRACTED)
            if held and size + part.num_rows > CONTRACTED:
                yield done()
                held, size = [], 0
            held.append([c.to_numpy() for c in part.columns])
            size += part.num_rows
    if held:
        yield done()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014).

    Returns (node, component) for every linked node, component being the smallest node of its component. Each round is
    two aggregations with map-side combine and two joins that AQE can split, and is written to the shared folder, in parts
    of EDGES_A_PART edges or so, however many partitions are set; no round gathers a component in one place. Before the first round each
    part's edges are contracted by themselves; where there is but one part, no round is left to do, which spares the driver its jobs.
    """
    u, v = F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")
    every = scratch(links.where(F.col(a) != F.col(b)).select(u, v).distinct(), "edges")
    parts = 1 + 2 * every.count() // EDGES_A_PART
    edges = scratch(map_arrow(every.coalesce(parts), _contract, "u long, v long"), "contracted")
    forget(every)
    mark = None
    while parts > 1:
        digest = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if digest == mark or digest[0] == 0:
            break
        mark, few = digest, 1 + 2 * digest[0] // EDGES_A_PART
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch(large.coalesce(few), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch(small.union(least).distinct().coalesce(few), "small-star")
        forget(edges, large)
        edges = small
    stars = edges.groupBy("u").agg(F.min("v").alias("v"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits with full avalanche."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of any slice of a byte string, after one prefix sum over random byte weights."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.weight = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**62, dtype=np.uint64)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(0, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 4096, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.r_[_U(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64) for x in (self.base, self.inverse))
        return self.up, self.down

    def prefix(self, data: np.ndarray) -> np.ndarray:
        up, _ = self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.weight[data] * up[: len(data)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each pair; equal strings hash alike wherever they stand."""
        return mix64((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))
