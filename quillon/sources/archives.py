"""Scopes as archives (chunks, vectors, manifest), forks, snapshots of tables, pages by key, and tagged graph rows."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

KIND, VERSION = "scope_archive", 1


def without_secrets(value):
    """A manifest without keys that name secrets, at any depth."""
    if isinstance(value, dict):
        return {k: without_secrets(v) for k, v in value.items() if k.lower() not in fixed.MANIFEST_SECRETS and not k.lower().endswith("_api_key")}
    return [without_secrets(v) for v in value] if isinstance(value, list) else value


def write_archive(chunks: DataFrame, vectors: DataFrame, path: str, **manifest) -> None:
    """chunks and vectors as NDJSON under path, and a manifest, written last: an archive without one is not whole."""
    spark = chunks.sparkSession
    counts = {}
    for name, rows in (("chunks", chunks), ("vectors", vectors)):
        rows.write.mode("overwrite").json(f"{path}/{name}")
        counts[name] = rows.count()
    said = without_secrets({**manifest, "kind": KIND, "manifest_version": VERSION, "chunk_count": counts["chunks"], "point_count": counts["vectors"]})
    spark.createDataFrame([(json.dumps(said, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_archive(spark: SparkSession, path: str, chunks: str, vectors: str) -> tuple[dict, DataFrame, DataFrame]:
    """(manifest, chunks, vectors) of an archive, rows by the given schemas; another kind or a later version is refused."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if manifest.get("kind") != KIND or not 1 <= int(manifest.get("manifest_version") or 0) <= VERSION:
        raise ValueError(f"unsupported archive: {manifest.get('kind')} {manifest.get('manifest_version')}")
    return manifest, spark.read.schema(chunks).json(f"{path}/chunks"), spark.read.schema(vectors).json(f"{path}/vectors")


def new_id(id_: Column, namespace: str) -> Column:
    """An id in another namespace, the same whenever it is asked for, in the form of a UUID."""
    digest = F.md5(F.concat_ws("\0", F.lit(namespace), id_.cast("string")))
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def fork(rows: DataFrame, namespace: str, ids: tuple[str, ...] = ("id",)) -> DataFrame:
    """rows in another namespace, under new ids; ids names the columns that hold one."""
    out = rows.withColumns({c: F.when(F.col(c).isNotNull(), new_id(F.col(c), namespace)) for c in ids})
    return out.withColumn("namespace", F.lit(namespace))


def tagged(tables: dict[str, DataFrame]) -> DataFrame:
    """value: a JSON text for each row of several tables, with its table's name as _table."""
    return reduce(DataFrame.union, [rows.select(F.to_json(F.struct(F.lit(name).alias("_table"), "*")).alias("value")) for name, rows in tables.items()])


def page(rows: DataFrame, key: str, after, most: int) -> DataFrame:
    """The next `most` rows by key after a key, or the first ones after None."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(most)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def snapshots(spark: SparkSession, root: str) -> list[str]:
    """Names of whole snapshots under root, oldest first: names sort by time."""
    at, files = _files(spark, root)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(n for n in names if all(files.exists(_files(spark, f"{root}/{n}/{mark}")[0]) for mark in ("_whole",)))


def snapshot(tables: dict[str, DataFrame], root: str, name: str) -> None:
    """Tables as Parquet under root/name; it counts from the moment that its mark is written."""
    spark = next(iter(tables.values())).sparkSession
    for table, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}/{table}")
    at, files = _files(spark, f"{root}/{name}/_whole")
    files.create(at, True).close()


def restore(spark: SparkSession, root: str, name: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/{table}")


def prune(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Delete all whole snapshots but the newest `keep`; the names that went."""
    gone = snapshots(spark, root)[: -keep or None] if keep else snapshots(spark, root)
    for name in gone:
        at, files = _files(spark, f"{root}/{name}")
        files.delete(at, True)
    return gone
