"""The write path: what one commit holds, soft deletes with parts, the queue's operations, two writers."""

import pytest
from pyspark.sql import functions as F

from quillon import scratch
from quillon.operators import writing
from quillon.sources.commits import Conflict

def now():
    return F.timestamp_seconds(F.lit(1_700_000_000))


KINDS = "id long, namespace string, agent string, text string, parent_id long, source_id long, importance double"


def rows(spark, *values):
    return spark.createDataFrame(list(values), KINDS)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


@pytest.fixture()
def store(spark):
    held = writing.Memories(spark, scratch.folder(spark, "memories"))
    held.store(rows(spark, (1, "n", "a", "one", None, None, 0.5), (2, "n", "b", "two", None, None, 0.5), (3, "n", "a", "needle of one", 1, None, 0.1), (4, "n", "a", "question of one", None, 1, 0.1), (5, "m", "c", "five", None, None, 0.9), (6, "", "c", "no namespace", None, None, 0.1), (7, "n", "c", " ", None, None, 0.1), (None, "n", "c", "no id", None, None, 0.1), (8, "n", "c", "stopped", None, None, 0.1)), now(), ids(spark, 8))
    return held


def state(store):
    return {r.id: r for r in store.live().collect()}


def test_one_commit_holds_all(spark, store):
    assert set(state(store)) == {1, 2, 3, 4, 5} and store.commits.version() == 1
    assert sorted((r.point_id, r.op) for r in store.commits.read("outbox").collect()) == [(i, "upsert") for i in (1, 2, 3, 4, 5)]
    assert sorted((r.memory, r.action) for r in store.commits.read("audit").collect()) == [(1, "store"), (2, "store"), (3, "store"), (4, "store"), (5, "store"), (8, "conflict")]
    other = writing.Memories(spark, store.commits.path)
    store.set_payload(ids(spark, 2), now(), F.lit(1.0))
    with pytest.raises(Conflict):
        other.commits.commit(1, {"memories": other.live(1).limit(0)})
    other.set_payload(ids(spark, 5), now(), F.lit(0.2))  # the second writer goes on from the first
    assert state(store)[2].importance == 1.0 and state(store)[5].importance == 0.2 and store.live(1).where("importance = 1").count() == 0


def test_soft_delete(spark, store):
    store.soft_delete(ids(spark, 1, 99), now())
    assert {i for i, r in state(store).items() if r.suppressed} == {1, 3, 4}
    assert sorted(r.point_id for r in store.commits.read("outbox").where("op = 'delete'").collect()) == [1, 3, 4]


def test_queue(spark, store):
    store.store(rows(spark, (10, "n", "a", "ten", None, None, 0.5), (11, "n", "a", "eleven", None, None, 0.5), (12, "n", "a", "twelve", None, None, 0.5)), now())
    ops = [("o1", "delete_memory", [1, 77], None), ("o2", "archive_memory", [1, 5], None), ("o3", "merge_memory", [2, 10, 1], None), ("o4", "merge_memory", [10, 11], None), ("o5", "update_hotness", None, {2: 0.7, 5: 0.1}), ("o6", "update_hotness", None, {2: 0.9}), ("o7", "skip_store", None, None), ("o8", "unknown", [12], None), ("o9", None, None, None)]
    store.drain(spark.createDataFrame(ops, "id string, op string, memory_ids array<bigint>, scores map<bigint,double>"), now())
    held = state(store)
    assert set(held) == {2, 5, 10, 11, 12}  # one and its parts are gone
    assert held[2].text == "two\n\nten" and held[10].suppressed and not held[11].suppressed and held[5].archived and not held[12].archived
    assert {r.id: r.status for r in store.commits.read("queue").collect()} == {"o1": "applied", "o2": "applied", "o3": "applied", "o4": "failed", "o5": "applied", "o6": "applied", "o7": "applied", "o8": "failed", "o9": "failed"}
    assert {r.id: r.score for r in store.commits.read("hotness").collect()} == {2: 0.9, 5: 0.1}
    assert sorted((r.point_id, r.op) for r in store.commits.read("outbox").where("seq = 3").collect()) == [(1, "delete"), (2, "upsert"), (3, "delete"), (4, "delete"), (5, "set_payload"), (10, "delete")]


def test_tips(spark):
    tips = spark.createDataFrame([(1, "a", "x", "t1", False), (2, "b", "x", "t2", False), (3, "b", "y", "t3", True)], "id long, agent string, category string, text string, archived boolean")
    made = spark.createDataFrame([(9, "fleet", "x", "t12")], "id long, agent string, category string, text string")
    assert {r.id: r.archived for r in writing.tips_after(tips, made, ids(spark, 1, 2)).collect()} == {1: True, 2: True, 3: True, 9: False}
