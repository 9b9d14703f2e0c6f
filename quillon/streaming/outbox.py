"""The outbox: queued changes applied once, retried with a growing delay, and set aside after too many failures."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import memory
from ..ship import ship

ATTEMPTS = 5

SETTLED_SQL = """with o as (select JSON_K(props) as point_id, event_id, event_type, case event_type when 'error' then 'delete' when 'purchase' then 'set_payload' else 'upsert' end as op from {events}),
  w as (select *, row_number() over (partition by point_id order by event_id desc) as rn from o) select point_id, event_id, op from w where rn = 1 and op <> 'delete'"""


def from_events(events: DataFrame) -> DataFrame:
    """event_id, point_id and op of each event."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "set_payload").otherwise("upsert")
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("point_id"), op.alias("op"))


def settled(changes: DataFrame) -> DataFrame:
    """The points that stand after all changes, each with its last one: an aggregation with map-side combine, whatever the order of arrival."""
    last = changes.groupBy("point_id").agg(F.max(F.struct("event_id", "op")).alias("last"))
    return last.select("point_id", "last.event_id", "last.op").where("op <> 'delete'")


def outcome(attempts: DataFrame) -> DataFrame:
    """attempts(event_id, tries, failed) with status and, for a retry, the delay in seconds: 2, 4, 8, ... up to ATTEMPTS."""
    status = F.when(~F.col("failed"), "applied").when(F.col("tries") >= ATTEMPTS, "dead").otherwise("pending")
    return attempts.withColumn("status", status).withColumn("delay_s", F.when(status == "pending", F.pow(F.lit(2.0), "tries")))


class Outbox(StatefulProcessor):
    """One change of an outbox: tried when it comes and, if that fails, again when its timer says so, until it is applied or dead.

    `attempt(change, tries)` applies a change, a Row, and raises or returns False if that fails. What is settled is kept for KEPT_DAYS, so a
    change that comes again in that time is not applied again. A micro-batch that is lost is run again from the state before it, so no change stays claimed
    by a task that died; `attempt` may then see a change twice, as with every outbox, and must be idempotent."""

    def __init__(self, attempt: Callable, kinds: str, tries: int, delay: float, longest: float):
        self.attempt, self.kinds, self.tries, self.delay, self.longest = attempt, kinds, tries, delay, longest

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", f"tries int, {self.kinds}")
        self.settled = handle.getValueState("settled", "status string", memory.KEPT_DAYS * 86_400_000)

    def _try(self, key, change: dict, tries: int, now: int):
        try:
            done, error = self.attempt(Row(**change), tries) is not False, "not applied"
        except Exception as e:  # what an attempt may raise is the caller's: it counts as a failure and is kept as the reason
            done, error = False, str(e)[:500]
        tries += not done
        status = "applied" if done else "dead" if tries >= self.tries else "pending"
        if status == "pending":
            self.waiting.update((tries, *change.values()))
            self.handle.registerTimer(now + int(1000 * min(self.delay * 2**tries, self.longest)))
        else:
            self.settled.update((status,))
            if self.waiting.exists():
                self.waiting.clear()
        yield Row(id=key[0], status=status, tries=tries, error=None if done else error, at=datetime.fromtimestamp(now / 1000, UTC))

    def handleInputRows(self, key, rows, timerValues):
        change = next(iter(rows)).asDict()
        if not self.waiting.exists() and not self.settled.exists():
            yield from self._try(key, change, 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.waiting.exists():
            tries, *values = self.waiting.get()
            names = [f.split()[0] for f in self.kinds.split(", ")]
            yield from self._try(key, dict(zip(names, values)), tries, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


OUTCOMES = "id long, status string, tries int, error string, at timestamp"


def drain(stream: DataFrame, attempt: Callable, tries: int = memory.TRIES, delay: float = 0.5, longest: float = memory.LONGEST_DELAY) -> DataFrame:
    """A stream of outcomes (id, status, tries, error, at) of a stream of changes(id, ...): each attempt of a change is a row, the last one "applied" or "dead"
    (T1, T2, T8, T11). Retries wait for 0.5 x 2^tries seconds, on timers, whether new changes come or not. Every change is a key of its own, so no queue
    is held in one task. Rows with a null id are left out. Other columns are of types that SQL names in one word."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ship(spark)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    keyed = stream.where("id is not null").groupBy("id")
    return keyed.transformWithState(Outbox(attempt, kinds, tries, delay, longest), OUTCOMES, "append", "processingTime")


class Sessions(StatefulProcessor):
    """A key's value with a time to live: put, get, flush and promote."""

    def __init__(self, ttl_seconds: float):
        self.ttl = int(1000 * ttl_seconds)

    def init(self, handle) -> None:
        self.value = handle.getValueState("value", "value string", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        for r in sorted(rows, key=lambda r: r.at):
            held = self.value.get()[0] if self.value.exists() else None
            if r.op == "put":
                self.value.update((r.value,))
            elif held is not None:
                if r.op in ("flush", "promote"):
                    self.value.clear()
                if r.op in ("get", "promote"):
                    yield Row(key=key[0], op=r.op, value=held, at=r.at)
            elif r.op == "get":
                yield Row(key=key[0], op=r.op, value=None, at=r.at)

    def close(self) -> None:
        pass


def session_stream(stream: DataFrame, ttl_seconds: float = 3600) -> DataFrame:
    """(key, op, value, at) for each get and promote of a stream of events(key, op, value, at), in order of time within a micro-batch: what the key holds, null if
    nothing or if it was put ttl_seconds ago. A promoted value leaves the session; its row is what a durable table takes (T10)."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ship(stream.sparkSession)
    return stream.groupBy("key").transformWithState(Sessions(ttl_seconds), "key string, op string, value string, at timestamp", "append", "processingTime")


def applied(changes: DataFrame) -> DataFrame:
    """(point_id, namespace, payload) of the points that stand after changes(seq, point_id, op, namespace, payload: map of strings), in order of seq (T4): an upsert
    takes a point's place whole, set_payload changes keys of one that stands, delete removes it, delete_filter removes all of its namespace. An upsert whose
    namespace is null is refused. Each step is an aggregation with map-side combine: a point or key that is changed often is one row for each task."""
    sound = changes.where("op <> 'upsert' or namespace is not null")
    last = lambda op, c: F.max(F.when(F.col("op") == op, c))
    of_point = sound.where("op in ('upsert', 'delete')").groupBy("point_id").agg(last("upsert", F.struct("seq", "namespace")).alias("put"), last("delete", F.col("seq")).alias("deleted"))
    of_space = sound.where("op = 'delete_filter'").groupBy("namespace").agg(F.max("seq").alias("cleared"))
    live = of_point.where("put is not null and (deleted is null or deleted < put.seq)").select("point_id", "put.namespace", F.col("put.seq").alias("since"))
    live = live.join(of_space, "namespace", "left").where("cleared is null or cleared < since").drop("cleared")
    set_ = sound.where("op in ('upsert', 'set_payload')").join(live, "point_id").where("seq >= since").select("point_id", "seq", F.explode("payload").alias("name", "value"))
    keys = set_.groupBy("point_id", "name").agg(F.max_by("value", "seq").alias("value"))
    payloads = keys.groupBy("point_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("payload"))
    return live.join(payloads, "point_id", "left").select("point_id", "namespace", F.coalesce("payload", F.create_map().cast("map<string,string>")).alias("payload"))


def sessions(events: DataFrame, now: Column, ttl_seconds: int = 3600, most: int = 512) -> DataFrame:
    """(key, value, at) that stand after events(key, op, value, at), ops put, get and flush (T10): the last put after a key's last flush, unless
    ttl_seconds have passed since, the `most` that were put or got last."""
    flushed = events.where("op = 'flush'").groupBy("key").agg(F.max("at").alias("flushed"))
    puts = events.where("op = 'put'").groupBy("key").agg(F.max(F.struct("at", "value")).alias("put"))
    used = events.where("op in ('put', 'get')").groupBy("key").agg(F.max("at").alias("used"))
    live = puts.join(flushed, "key", "left").join(used, "key").where(F.col("flushed").isNull() | (F.col("put.at") > F.col("flushed")))
    live = live.where(F.col("put.at") > now - F.make_dt_interval(secs=F.lit(float(ttl_seconds))))
    return live.orderBy(F.desc("used"), "key").limit(most).select("key", F.col("put.value").alias("value"), F.col("put.at").alias("at"))


def action_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts of actions in windows of event time; state older than the watermark is dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("window"), "event_type").agg(F.count("*").alias("n"))
