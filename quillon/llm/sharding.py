"""Byte-balanced shards by Karmarkar-Karp differencing.

Equal texts are one group and stay together. Groups fall by hash into CELLS cells, a fixed number, whose bytes are differenced:
the two partial partitions with the largest spread are combined in opposite order, again and again, until one is left. A
group that weighs more than a SPLIT-th of a mean shard is an item of its own, and is split only if it alone weighs more
than a mean shard, into the fewest parts that do not. Its rows are ranked in cells dealt by doc_id, so that no task has to
sort a whole group; the cells of an item go to one shard. Such groups are at most SPLIT x shards in number, so what
reaches the driver has a proven bound; slots come from counts of cells and ranks within a cell.

Law: bytes (near-equal sizes). A row weighs its text's UTF-8 bytes and 16.

Defined results: null text has no bytes and is a text of its own kind, like the empty one; repeated rows are rows; a
null doc_id is a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

SHARDS, CELLS, SPLIT, ROW_BYTES = 40, 8192, 16, 16


def differencing(sizes: list[int], shards: int) -> list[int]:
    """A shard for each item, by the largest differencing method on partitions of `shards` sums."""
    heap = []
    for k, size in enumerate(sizes):
        sums = [(0, [])] * (shards - 1) + [(size, [k])]
        heap.append((-size, k, sums))
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted(((x + y, p + q if p and q else p or q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda z: z[0])
        low = both[0][0]
        both = [(x - low, p) for x, p in both]
        heapq.heappush(heap, (-both[-1][0], turn, both))
        turn += 1
    out = [0] * len(sizes)
    for shard, (_, items) in enumerate(heap[0][2] if heap else []):
        for k in items:
            out[k] = shard
    return out


def items(totals: list[tuple], mean: int) -> list[list[int]]:
    """Indices of totals (own, group, cell, bytes, n) that go to one shard together: each common cell by itself, and the cells of
    a group of its own, by parts if the group weighs more than a mean shard."""
    out, groups = [], {}
    for k, (own, group, _, _, _) in enumerate(totals):
        if own:
            groups.setdefault(group, []).append(k)
        else:
            out.append([k])
    for held in groups.values():
        sizes = [totals[k][3] for k in held]
        parts = -(-sum(sizes) // mean)
        dealt = differencing(sizes, parts) if parts > 1 else [0] * len(held)
        out += [part for p in range(parts) if (part := [k for k, at in zip(held, dealt) if at == p])]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS, split: int = SPLIT) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of docs(doc_id, text)."""
    raw = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw, F.crc32(raw)).alias("group"))
    rows = scratch(rows, "sizes")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    limit = max(1, total // (shards * split))
    heavy = rows.groupBy("group").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > limit).select("group", F.ceil(F.col("bytes") / limit).cast("long").alias("parts"))
    heavy = F.broadcast(scratch(heavy, "heavy"))  # at most shards * split rows
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", "group"), F.col("parts")))
    celled = rows.join(heavy, "group", "left").withColumn("cell", F.when(part.isNotNull(), F.xxhash64("group", part)).otherwise(F.pmod("group", F.lit(cells))))
    celled = celled.withColumn("own", F.col("parts").isNotNull()).select("doc_id", "size", "text_crc32", "group", "own", "cell")
    totals = celled.groupBy("own", F.when(F.col("own"), F.col("group")).alias("group"), "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    totals = sorted((r.own, r.group or 0, r.cell, r.bytes, r.n) for r in totals.collect())  # at most cells + 2 * shards * split rows
    parts, places, used = items(totals, max(1, total // shards)), [], [0] * shards
    for part, at in zip(parts, differencing([sum(totals[k][3] for k in part) for part in parts], shards)):
        for own, _, cell, _, n in (totals[k] for k in part):
            places.append((own, cell, at, used[at]))
            used[at] += n
    places = F.broadcast(docs.sparkSession.createDataFrame(places, "own boolean, cell long, shard int, before long"))
    rank = F.row_number().over(Window.partitionBy("own", "cell").orderBy("group", "doc_id", "size"))
    out = celled.withColumn("rank", rank).join(places, ["own", "cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
