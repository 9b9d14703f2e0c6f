"""Text rules and chunkers on cases worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillon.functions import chunking, text


def test_paragraphs_are_gathered_and_overlap():
    long = [f"p{k} " + "word " * 20 for k in range(6)]
    got = chunking.paragraphs("\n\n".join([*long, "  ", "end"]), 300, 16)
    assert got[0] == "\n\n".join(p.strip() for p in long[:2]) and got[1].startswith("word word word word\n\np2 word")
    assert got[-1].endswith("end") and len(got) == 3
    assert chunking.paragraphs("a b c\n\n" + "x" * 20, 10, 100) == ["a b c", "x" * 20]  # too few words for an overlap
    assert chunking.paragraphs(" \n\n ") == [] and chunking.paragraphs("one") == ["one"]


def test_sections_keep_headings_and_fences():
    assert chunking.sections("  short  ") == ["short"] and chunking.sections(" ") == []
    code = "```\nline one\n\nline two\n" + "x = 1\n" * 30 + "```"
    doc = "intro\n\n# One\nbody one\n\n## Two\n" + "para a " * 10 + "\n\n" + code + "\n\n" + "para b " * 10
    got = chunking.sections(doc, 150, 8)
    assert got[:2] == ["intro", "# One\n\nbody one"] and got[2].startswith("## Two\n\npara a") and all(g.startswith("## Two (cont.)\n\n") for g in got[3:])
    assert sum(code in g for g in got) == 1  # the fence is whole, though it is longer than a chunk
    assert not any("One" in g for g in got[2:])


def test_needles_have_windows():
    words = "some words that say little " * 8
    got = chunking.needle_chunks(f"{words} at 10.0.0.1/24 and TICK-1234 then {words * 2} id 0a1b2c3d-0000-4000-8000-ABCDEF012345 {words}")
    assert len(got) == 2 and "10.0.0.1/24" in got[0] and "TICK-1234" in got[0] and "ABCDEF012345" in got[1] and max(map(len, got)) <= 200
    assert chunking.needle_chunks("no needles here") == [] and chunking.needle_chunks(" :80") == []  # under ten characters


def test_levels_have_stable_ids(spark):
    rows = list(chunking.levels("first paragraph\n\nat 10.1.2.3 second", "a.md"))
    parent = rows[0]
    digest = hashlib.md5("a.md\0000\0first paragraph\n\nat 10.1.2.3 second".encode()).hexdigest()
    assert parent[0] == f"{digest[:8]}-{digest[8:12]}-{digest[12:16]}-{digest[16:20]}-{digest[20:]}" and parent[1:3] == (None, "parent")
    assert [r[2] for r in rows] == ["parent", "child", "needle"] and {r[1] for r in rows[1:]} == {parent[0]}
    assert [r[0] for r in chunking.levels("x", "a.md")] != [r[0] for r in chunking.levels("x", "b.md")]
    docs = spark.createDataFrame([("a.md", "first paragraph\n\nat 10.1.2.3 second"), ("b.md", None), ("c.md", "")], "id string, text string")
    got = chunking.level_chunks(docs).orderBy("place").collect()
    assert [(g.id, g.chunk_id, g.content) for g in got] == [("a.md", r[0], r[3]) for r in rows]
    assert chunking.paragraph_chunks(docs).count() == chunking.section_chunks(docs).count() == 1


@pytest.fixture(scope="module")
def of(spark):
    def value(text_, rule):
        return spark.createDataFrame([(text_,)], "t string").select(rule(F.col("t")).alias("v")).first().v

    return value


def test_search_expressions(of):
    assert of('what is "the port" (of) k8s?', text.any_expression) == '"what" OR "is" OR "the" OR "port" OR "of" OR "k8s"'
    assert of("What is the Port of k8s?", text.all_expression) == '"port" AND "k8s"' and of("the port", text.all_expression) == ""
    assert of("Pod restart loop", text.phrase_expression) == '"pod restart loop"' and of("it's a pod", text.all_lexemes) == "'its' & 'pod'"
    assert of("a b", text.any_lexemes) == "'a' | 'b'" and of("pod 'restart'", text.lexemes_in_order) == "'pod' <-> 'restart'"
    assert of(None, text.any_expression) == of(" ?! ", text.any_expression) == ""


def test_thoughts_topics_and_kinds(of):
    assert of("# Lessons learned\nnothing", text.thought_type) == "lesson" and of("it was fixed", text.thought_type) == "general"
    assert of("we shipped and deployed", text.thought_type) == "milestone" and of(None, text.thought_type) == "general"
    assert of("pod pod helm; SQL schema query, sqlx", text.topics) == ["kubernetes", "database"] and of("one pod", text.topics) == []
    assert of("one pod", text.query_topic) == "kubernetes" and of("", text.query_topic) == ""
    assert tuple(of("how to run kubectl", text.query_kind)) == ("skill", "command") and tuple(of("hello", text.query_kind)) == ("", "")


def test_entities(of):
    got = of("**Argo CD** **Prod-db.1** `kube-proxy` **TODO** `argo` `KUBE-PROXY` `x`", text.entities)
    assert [tuple(e) for e in got] == [("Prod-db.1", "host"), ("kube-proxy", "kubernetes"), ("argo", "unknown")]
    got = of("10.0.0.1 on web-01-eu, not well-known-word; AB-1234 10.0.0.1", text.needle_entities)
    assert [tuple(e) for e in got] == [("10.0.0.1", "ip_address"), ("AB-1234", "ticket_id"), ("web-01-eu", "hostname")]


def test_paths_fences_and_labels(of):
    assert [of(p, text.agent_of_path) for p in ("x/agents/ann/a.md", "memories/bob/agents", "a.md", None)] == ["ann", "bob", "", ""]
    assert of(' ```json\n{"a": 1}\n``` ', text.without_fences) == '{"a": 1}' and of("plain ", text.without_fences) == "plain"
    assert of("a b/ü-1_", text.safe_label) == "a_b__-1_"
    assert of("port :8080 and :9090 at 1.2.3.4", text.literal_tokens) == ["1.2.3.4", ":8080", ":9090"]
