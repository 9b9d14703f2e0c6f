import time

import pytest
from pyspark.sql import functions as F

from quillon.functions import chunking
from quillon.operators import ordered
from quillon.sources import archives, markdown, ndjson
from quillon.streaming import outbox


def test_greedy_packing_goes_on_after_a_hit_that_does_not_fit(spark):
    hits = spark.createDataFrame([(1, 1, 10, 50), (1, 2, 11, 60), (1, 3, 12, 40), (2, 1, 10, 500)], "query long, rank long, id long, tokens long")
    got = {(r.query, r.id): r.packed for r in ordered.pack_greedy(hits, 100, 0).collect()}
    assert got == {(1, 10): True, (1, 11): False, (1, 12): True, (2, 10): False}
    assert all(r.packed for r in ordered.pack_greedy(hits, 0, 3).collect())


def test_adaptive_packing_stays_within_budget(spark):
    hits = spark.createDataFrame([(1, k, k, 10, 40, 90) for k in range(1, 9)], "query long, rank long, id long, l0 long, l1 long, l2 long")
    rows = ordered.pack_adaptive(hits, 200, 0.3, 2).collect()
    cost = {None: 0, "l0": 10, "l1": 40, "l2": 90}
    assert sum(cost[r.tier] for r in rows) <= 200
    assert [r.tier for r in sorted(rows, key=lambda r: r.rank)].count(None) == 2


def test_clusters_follow_the_first_seed(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 2, [0.99, 0.05]), (0, 3, [0.0, 1.0]), (1, 4, [1.0, 0.0])]
    got = {r.id: r.seed for r in ordered.greedy_clusters(spark.createDataFrame(rows, "topic long, id long, vector array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_ndjson_sets_malformed_lines_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ndjson").write_text('{"id": 1, "v": [1.0]}\n{"id": \n{"_table": "facts"}\n{"v": [2.0]}\n')
    rows, skipped = ndjson.load(spark, str(tmp_path / "in"), "id long, v array<double>", ("id", "v"))
    assert [r.id for r in rows.collect()] == [1] and skipped.count() == 3


def test_markdown_scan_and_changes(spark, tmp_path):
    folder = tmp_path / "agents/ann/weekly"
    folder.mkdir(parents=True)
    (folder / "2024-01-05.md").write_text("# Plan\nDo a thing or two.\n## Next\nMore of it.")
    (folder / "short.md").write_text("tiny")
    files = markdown.scan(spark, str(tmp_path))
    row = files.collect()
    assert [(r.agent_id, str(r.date), r.file_type) for r in row] == [("ann", "2024-01-05", "weekly")]
    assert markdown.changed(files, files).count() == 0
    parts = markdown.sections(files.selectExpr("1 as id", "text")).orderBy("section").collect()
    assert [(p.title, p.body) for p in parts] == [("Plan", "Do a thing or two."), ("Next", "More of it.")]


def test_outbox(spark, tmp_path):
    rows = [(1, 7, "upsert"), (2, 7, "delete"), (3, 8, "upsert"), (4, 8, "set_payload")]
    changes = spark.createDataFrame(rows, "event_id long, point_id long, op string")
    assert [(r.point_id, r.event_id) for r in outbox.settled(changes).collect()] == [(8, 4)]
    tries = outbox.outcome(spark.createDataFrame([(1, 1, False), (2, 2, True), (3, 5, True)], "event_id long, tries int, failed boolean"))
    assert [(r.status, r.delay_s) for r in tries.orderBy("event_id").collect()] == [("applied", None), ("pending", 4.0), ("dead", None)]


def _until(query, done, seconds=240):
    """Let a stream run until a condition holds, then stop it."""
    end = time.time() + seconds
    while time.time() < end and query.isActive and not done():
        time.sleep(0.3)
    query.stop()
    assert done(), query.exception()


def test_outbox_stream_ends_with_all_settled(spark, tmp_path):
    """130 changes in one micro-batch: all are applied but one, without new data; a restart applies nothing twice."""
    put = lambda ids: spark.createDataFrame([(i, f"p{i}") for i in ids], "id long, payload string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(range(130))

    def attempt(change, tries):
        if change.id == 7 or (change.id % 10 == 3 and tries < 2):
            raise ValueError(f"{change.payload} at {tries}")
        return change.id != 50 or tries > 0

    def start():
        stream = spark.readStream.schema("id long, payload string").parquet(str(tmp_path / "in"))
        out = outbox.drain(stream, attempt, tries=4, delay=0.05).writeStream.format("parquet").outputMode("append")
        return out.option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="200 milliseconds").start(str(tmp_path / "out"))

    def outcomes():
        return spark.read.schema(outbox.OUTCOMES).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out").exists() else []

    _until(start(), lambda: sum(r.status != "pending" for r in outcomes()) == 130)
    first = outcomes()
    ended = {r.id: (r.status, r.tries, r.error) for r in first if r.status != "pending"}
    assert ended[7] == ("dead", 4, "p7 at 3") and ended[3] == ("applied", 2, None) and ended[50] == ("applied", 1, None)
    assert all(s == "applied" and n == (2 if i % 10 == 3 else i == 50) for i, (s, n, _) in ended.items() if i != 7)
    assert sorted(r.tries for r in first if r.id == 7) == [1, 2, 3, 4]
    put([1, 7, 13, 500, 501])  # three of them again
    _until(start(), lambda: len(outcomes()) >= len(first) + 2)
    assert {r.id for r in outcomes()} - set(ended) == {500, 501} and len(outcomes()) == len(first) + 2


def test_session_stream(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, "key string, op string, value string, s long").selectExpr("key", "op", "value", "timestamp_seconds(s) as at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("a", "put", "1", 1), ("a", "get", None, 2), ("a", "put", "2", 3), ("a", "promote", None, 4), ("a", "get", None, 5), ("b", "put", "x", 1), ("b", "flush", None, 2), ("b", "promote", None, 3), ("c", "put", "y", 1)])
    stream = spark.readStream.schema("key string, op string, value string, at timestamp").parquet(str(tmp_path / "in"))
    query = outbox.session_stream(stream, 3).writeStream.format("memory").queryName("sessions_seen").outputMode("append").option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="200 milliseconds").start()
    seen = lambda: sorted(((r.key, r.op, r.value) for r in spark.table("sessions_seen").collect()), key=repr)
    end = time.time() + 120
    while time.time() < end and len(seen()) < 3:
        time.sleep(0.3)
    assert seen() == [("a", "get", "1"), ("a", "get", None), ("a", "promote", "2")]
    time.sleep(4)  # c's value has run out
    put([("c", "get", None, 9)])
    _until(query, lambda: spark.table("sessions_seen").where("key = 'c'").count() == 1)
    assert spark.table("sessions_seen").where("key = 'c'").first().value is None


def test_applied_changes(spark):
    rows = [
        (1, 1, "upsert", "n", {"a": "1", "b": "2"}), (2, 1, "set_payload", None, {"b": "3", "c": "4"}), (3, 2, "upsert", "n", {"a": "x"}), (4, 2, "delete", None, None), (5, 2, "set_payload", None, {"a": "lost"}),
        (6, 3, "upsert", "m", {"a": "y"}), (7, None, "delete_filter", "m", None), (8, 4, "upsert", "m", None), (9, 5, "set_payload", "n", {"a": "no point"}), (10, 6, "upsert", None, {"a": "no namespace"}), (11, 1, "upsert", "n", {"d": "5"}), (12, 1, "set_payload", None, {"d": None}),
    ]
    changes = spark.createDataFrame(rows, "seq long, point_id long, op string, namespace string, payload map<string,string>")
    assert {r.point_id: (r.namespace, r.payload) for r in outbox.applied(changes).collect()} == {1: ("n", {"d": None}), 4: ("m", {})}
    assert outbox.applied(changes.limit(0)).count() == 0


def test_sessions_end(spark):
    rows = [("a", "put", "1", 10), ("a", "put", "2", 20), ("b", "put", "x", 30), ("b", "flush", None, 40), ("c", "put", "y", 50), ("c", "get", None, 5000), ("d", "put", "z", 4990), ("e", "get", None, 1)]
    events = spark.createDataFrame(rows, "key string, op string, value string, s long").selectExpr("key", "op", "value", "timestamp_seconds(s) as at")
    of = lambda now, most=512: [(r.key, r.value) for r in outbox.sessions(events, F.timestamp_seconds(F.lit(now)), 3600, most).collect()]
    assert of(100) == [("c", "y"), ("d", "z"), ("a", "2")] and of(3625) == [("c", "y"), ("d", "z")] and of(100, 1) == [("c", "y")] and of(9000) == []


def test_archives_forks_and_snapshots(spark, tmp_path):
    chunks, vectors = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "id long, text string, parent long"), spark.createDataFrame([(1, [0.5])], "id long, vector array<double>")
    archives.write_archive(chunks, vectors, str(tmp_path / "one"), label="x", api_key="k", more={"token": 1, "ok": [{"Password": 2, "n": 3}], "my_api_key": 4})
    manifest, c, v = archives.read_archive(spark, str(tmp_path / "one"), "id long, text string, parent long", "id long, vector array<double>")
    assert manifest == {"kind": archives.KIND, "manifest_version": 1, "chunk_count": 2, "point_count": 1, "label": "x", "more": {"ok": [{"n": 3}]}}
    assert sorted(map(tuple, c.collect())) == [(1, "a", None), (2, "b", 1)] and v.first().vector == [0.5]
    spark.createDataFrame([('{"kind": "other", "manifest_version": 1}',)], "value string").write.mode("overwrite").text(str(tmp_path / "one/manifest"))
    with pytest.raises(ValueError):
        archives.read_archive(spark, str(tmp_path / "one"), "id long", "id long")
    forked = {r.text: r for r in archives.fork(chunks, "new", ("id", "parent")).collect()}
    assert forked["b"].parent == forked["a"].id != forked["b"].id and forked["a"].parent is None and len(forked["a"].id) == 36 and forked["a"].namespace == "new"
    root = str(tmp_path / "snaps")
    for name in ("2024-01", "2024-02", "2024-03"):
        archives.snapshot({"chunks": chunks}, root, name)
    chunks.write.parquet(f"{root}/2024-04/chunks")  # broken off
    assert archives.snapshots(spark, root) == ["2024-01", "2024-02", "2024-03"] and archives.prune(spark, root, 1) == ["2024-01", "2024-02"]
    assert archives.restore(spark, root, "2024-03", "chunks").count() == 2 and archives.snapshots(spark, root + "x") == []
    lines = [r.value for r in archives.tagged({"facts": chunks.where("id = 1"), "points": vectors}).collect()]
    assert sorted(lines) == ['{"_table":"facts","id":1,"text":"a"}', '{"_table":"points","id":1,"vector":[0.5]}']
    assert [r.id for r in archives.page(chunks, "id", None, 1).collect()] == [1] and [r.id for r in archives.page(chunks, "id", 1, 5).collect()] == [2]


def test_files_are_indexed_anew(spark, tmp_path):
    files = spark.createDataFrame([("a.md", "first text of a file"), ("b.md", "second")], "path string, text string")
    chunks = markdown.reindexed(chunking.level_chunks(files.selectExpr("path as id", "text").limit(0)), files)
    again = markdown.reindexed(chunks, spark.createDataFrame([("a.md", "changed text")], "path string, text string"), spark.createDataFrame([("b.md",)], "path string"))
    assert {r.id: r.content for r in again.where("kind = 'parent'").collect()} == {"a.md": "changed text"}


def test_a_value_that_names_a_table_is_no_tag(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ndjson").write_text('{"id": 1, "t": "the \\"_table\\" of it"}\n{"_table": "facts", "id": 2}\n')
    rows, skipped = ndjson.load(spark, str(tmp_path / "in"), "id long, t string", ("id",))
    assert [r.id for r in rows.collect()] == [1] and skipped.count() == 1
