"""The write path: memories, outbox and audit rows change together in one commit; soft deletes; the curator's queue.

Tables under one log of commits: memories (id, namespace, agent, text, parent_id, source_id, importance, archived, suppressed, gone), outbox (event_id, point_id,
op, namespace, at), audit (memory, action, agent, at), hotness (id, score, gone) and queue (id, op, status, gone). A reader sees a memory with its outbox and audit rows or none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import Commits, latest

MEMORY = ("id", "namespace", "agent", "text", "parent_id", "source_id", "importance", "archived", "suppressed", "gone")
# Kinds of operations in the queue, and memories that a merge needs.
OPS = ("merge_memory", "archive_memory", "delete_memory", "consolidate_tips", "update_hotness", "skip_store")
MERGE_OF = 2


def _event(rows: DataFrame, op: str, now: Column) -> DataFrame:
    """An outbox row for each of rows, with an id that is the same whenever the same change is made."""
    return rows.select(F.sha2(F.concat_ws(":", F.lit(op), F.col("id").cast("string"), now.cast("string")), 256).alias("event_id"), F.col("id").alias("point_id"), F.lit(op).alias("op"), "namespace", now.alias("at"))


def _audit(rows: DataFrame, action: str, now: Column) -> DataFrame:
    return rows.select(F.col("id").alias("memory"), F.lit(action).alias("action"), "agent", now.alias("at"))


class Memories:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.commits = spark, Commits(spark, path)

    def live(self, version: int | None = None) -> DataFrame | None:
        rows = self.commits.read("memories", version)
        return None if rows is None else latest(rows, "id")

    def store(self, memories: DataFrame, now: Column, blocked: DataFrame | None = None) -> int:
        """memories(id, namespace, agent, text, parent_id, source_id, importance) but those whose id is in blocked(id), which the conflict gate stopped: their audit
        row says so, and nothing else is written of them (M22, T5). A row without an id, namespace or text is refused, without a trace. Of several with one id any one is taken."""
        sound = memories.where("id is not null and coalesce(namespace, '') <> '' and trim(coalesce(text, '')) <> ''").dropDuplicates(["id"])
        stopped = sound.join(blocked.select("id").distinct(), "id", "left_semi") if blocked is not None else sound.limit(0)
        passed = sound.join(stopped.select("id"), "id", "left_anti")
        rows = passed.select("id", "namespace", "agent", "text", "parent_id", "source_id", "importance", *[F.lit(False).alias(c) for c in MEMORY[7:]])
        adds = {"memories": rows, "outbox": _event(rows, "upsert", now), "audit": _audit(rows, "store", now).union(_audit(stopped, "conflict", now))}
        return self.commits.change(lambda base: (adds, {}))

    def _with_parts(self, ids: DataFrame, base: int) -> DataFrame:
        """Memories of ids and what stands under them: their needles' chunks and the texts that were made from them."""
        live, asked = self.live(base), ids.select("id").distinct()
        own = live.join(asked, "id", "left_semi")
        for c in ("parent_id", "source_id"):
            own = own.union(live.join(asked.withColumnRenamed("id", c), c, "left_semi").select(*live.columns))
        return own.dropDuplicates(["id"])

    def _marked(self, ids: DataFrame, now: Column, action: str, op: str | None, **marks: Column) -> int:
        def make(base: int):
            rows = self._with_parts(ids, base).withColumns(marks)
            adds = {"memories": rows.select(*MEMORY), "audit": _audit(rows, action, now)}
            return (adds | {"outbox": _event(rows, op, now)} if op else adds), {}

        return self.commits.change(make)

    def soft_delete(self, ids: DataFrame, now: Column) -> int:
        """ids(id) and what stands under them are hidden at once; their hard delete waits in the outbox."""
        return self._marked(ids, now, "soft_delete", "delete", suppressed=F.lit(True))

    def set_payload(self, ids: DataFrame, now: Column, importance: Column) -> int:
        """Another importance for ids(id) and their parts."""
        return self._marked(ids, now, "set_payload", "set_payload", importance=importance)

    def drain(self, ops: DataFrame, now: Column) -> int:
        """ops(id, op, memory_ids, scores: map of hotness by memory) applied in one commit, each with its status in `queue` (M28, Z17). A merge of fewer than two memories and an
        unknown kind fail; so what they name stays as it is. A memory that is deleted is not archived or merged besides; of several merges, the one with the least id takes it."""

        def make(base: int):
            live = self.live(base)
            named = ops.select("id", "op", F.explode_outer(F.array_distinct("memory_ids")).alias("memory"))
            held = named.join(live.select(F.col("id").alias("memory"), "namespace", "agent", "text"), "memory", "left_semi")
            deleted = held.where("op = 'delete_memory'").select(F.col("memory").alias("id"))
            gone = self._with_parts(deleted, base).withColumn("gone", F.lit(True))
            merging = held.where("op = 'merge_memory'").join(gone.select(F.col("id").alias("memory")), "memory", "left_anti")
            own = merging.groupBy("memory").agg(F.min("id").alias("id"))
            counts = own.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= MERGE_OF)
            taken = own.join(counts, "id").join(live.withColumnRenamed("id", "memory"), "memory")
            # the text of all, in order of id, as the least memory's; the others are hidden
            texts = taken.groupBy(F.col("id").alias("op_id")).agg(F.min("memory").alias("id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("memory", "text"))), lambda x: x["text"]), "\n\n").alias("all_text"))
            merged = live.join(texts.select("id", "all_text"), "id").withColumn("text", F.col("all_text")).drop("all_text")
            hidden = live.join(taken.select(F.col("memory").alias("id")).join(texts.select("id"), "id", "left_anti"), "id", "left_semi").withColumn("suppressed", F.lit(True))
            archived = self._with_parts(held.where("op = 'archive_memory'").select(F.col("memory").alias("id")), base)
            archived = archived.join(gone.select("id"), "id", "left_anti").join(taken.select(F.col("memory").alias("id")), "id", "left_anti").withColumn("archived", F.lit(True))
            rows = gone.select(*MEMORY).union(merged.select(*MEMORY)).union(hidden.select(*MEMORY)).union(archived.select(*MEMORY))
            hot = ops.where("op = 'update_hotness'").select(F.col("id").alias("by"), F.explode("scores").alias("memory", "score")).groupBy(F.col("memory").alias("id")).agg(F.max_by("score", "by").alias("score"))
            status = F.when(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), "failed").when((F.col("op") == "merge_memory") & F.col("n").isNull(), "failed").otherwise("applied")
            done = ops.join(counts, "id", "left").select("id", "op", F.coalesce(status, F.lit("failed")).alias("status"), F.lit(False).alias("gone"))
            audit = [_audit(r, a, now) for r, a in ((gone, "delete"), (merged, "merge"), (hidden, "merged_away"), (archived, "archive"))]
            every = audit[0].union(audit[1]).union(audit[2]).union(audit[3])
            events = _event(gone, "delete", now).union(_event(merged, "upsert", now)).union(_event(hidden, "delete", now)).union(_event(archived, "set_payload", now))
            return {"memories": rows, "audit": every, "outbox": events, "hotness": hot.withColumn("gone", F.lit(False)), "queue": done}, {}

        return self.commits.change(make)


def tips_after(tips: DataFrame, made: DataFrame, originals: DataFrame) -> DataFrame:
    """tips(id, agent, category, text, archived) with made(id, agent, category, text) and those of originals(id) archived."""
    out = tips.join(originals.select("id", F.lit(True).alias("_old")).distinct(), "id", "left")
    out = out.select("id", "agent", "category", "text", (F.col("archived") | F.coalesce("_old", F.lit(False))).alias("archived"))
    return out.union(made.select("id", "agent", "category", "text", F.lit(False)))
