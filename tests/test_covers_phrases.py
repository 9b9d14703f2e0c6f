"""Covers whose parts end at one place, and phrases that share words, on small indexes."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillon import scratch
from quillon.operators import fulltext


def indexed(spark, texts):
    index = fulltext.Index(spark, scratch.folder(spark, "covers"))
    index.upsert(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    return index


def test_places_with_one_end_move_together(spark):
    index = indexed(spark, ["bar foo x foo bar foo", "foo bar one two foo three bar foo", "foo"])
    got = index.search(spark.createDataFrame([(1, "foo bar-foo")], "query long, text string"), 5, "all", by="density").collect()
    # of the first: covers at 0 to 1 and 4 to 5; of the second: one at 6 to 7, as its last pair stands alone
    assert {r.id: round(r.score, 4) for r in got} == {0: 6.4, 1: 3.2}


def test_words_of_long_parts_count_once():
    one, two = (np.array([6]), 1), (np.array([5, 9]), 4)
    # covers at 5 to 8, which holds the word at 6, and at 6 to 12 with two other words, from which the part at 5 is out
    assert round(fulltext.density([one, two], "all"), 4) == round(3.2 + 3.2 / 3, 4)


def test_places_do_not_grow_with_parts(spark):
    """What is exchanged for phrases is a row for each chunk, however many phrases hold a word."""
    texts = ["every word of this text stands in many phrases"] * 40
    index, words = indexed(spark, texts), texts[0].split()
    parts = [words[a:b] for a in range(len(words)) for b in range(a + 2, len(words) + 1)]
    placed, phrases = index._placed(parts, True, index.commits.version())
    rows = placed.groupBy("id", "seq").agg(F.collect_list("positions").alias("positions"))
    assert placed.count() <= 2 * len(texts) and rows.count() == len(texts)
    bounds, number, place = fulltext._unpacked(pa.array([rows.first().positions], pa.list_(pa.binary())))
    found = phrases.found(*next(fulltext._chunks(pa.array([rows.first().positions], pa.list_(pa.binary())))))
    assert len(number) == len(words) == bounds[-1] and sorted(place) == list(range(len(words)))
    assert len(found) == len(parts) and all(begins.tolist() == [words.index(parts[k][0])] for k, begins in found.items())


def test_what_a_dual_search_moves_does_not_grow_with_its_queries(spark):
    """Counts and places of a chunk are moved packed and once: many phrases of the same words take a small part more than few."""
    draw, words = random.Random(3), [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    index = indexed(spark, [" ".join(draw.choices(words, k=60)) for _ in range(1500)])
    context = spark.sparkContext._jsc.sc()

    def moved(n):
        context.listenerBus().waitUntilEmpty(30_000)
        before = context.statusStore().executorSummary("driver").totalShuffleWrite()
        queries = spark.createDataFrame([(k, " ".join(draw.sample(words, 2))) for k in range(n)], "query long, text string")
        assert index.dual(queries, 5, many=1).select("query").distinct().count() == n
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite() - before

    assert moved(160) < 2 * moved(40)


def test_packed_pairs_come_back():
    rng = random.Random(1)
    lists = [sorted((rng.choice((0, 1, 2, 130, 2**21, 2**30)), rng.choice((0, 1, 127, 128, 40_000, 2**31 - 1))) for _ in range(rng.randrange(1, 9))) for _ in range(50)]
    flat = np.array([x for one in lists for x in one])
    packed = fulltext._packed(flat[:, 0], flat[:, 1], np.r_[0, np.cumsum(list(map(len, lists)))[:-1]]).to_pylist()
    rows = [[], packed[:1], packed[1:4], [], packed[4:], []]
    bounds, number, value = fulltext._unpacked(pa.array(rows, pa.list_(pa.binary())))
    want = [[], lists[0], [x for one in lists[1:4] for x in one], [], [x for one in lists[4:] for x in one], []]
    assert [list(zip(number[a:b].tolist(), value[a:b].tolist())) for a, b in zip(bounds[:-1], bounds[1:])] == [[tuple(x) for x in one] for one in want]


def test_phrases_of_many_chunks_at_once():
    """Counts of parts in chunks held together are those of each chunk by itself, also where places are near a chunk's ends."""
    rng, most = random.Random(2), 2**31 - 1
    parts = {k: [rng.randrange(4) for _ in range(rng.randrange(1, 5))] for k in range(40)}
    phrases = fulltext._Phrases(parts, {t: rng.randrange(1, 9) for t in range(4)})
    chunks = [[(t, k) for k, t in enumerate(rng.randrange(5) for _ in range(rng.randrange(30)))] for _ in range(50)] + [[(0, most)], [(k % 4, most - 3 + k) for k in range(4)]]
    flat = np.array([(row, t, place) for row, one in enumerate(chunks) for t, place in one])
    row, part, n = phrases.counted(*flat[rng.sample(range(len(flat)), len(flat))].T)
    want = {}
    for k, one in enumerate(chunks):
        at = {place: t for t, place in one}
        for p, tokens in parts.items():
            if found := sum(all(at.get(b + j) == t for j, t in enumerate(tokens)) for b in at):
                want[k, p] = found
    assert dict(zip(zip(row.tolist(), part.tolist()), n.tolist())) == want and list(zip(row, part)) == sorted(want)
    assert [len(x) for x in phrases.counted(*np.zeros((3, 0), np.int64))] == [0, 0, 0]


def test_postings_are_made_in_one_pass(spark, monkeypatch):
    """No sort of more than a block: rows come by stem and term in each block, and hold every place of every chunk."""
    texts = ["Running runs, runİ\n9", None, "run zéro running", "", "the run", "a " * 70]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    made = fulltext.postings(rows)
    assert "Sort" not in made._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(fulltext, "BYTES", 40)
    blocks = [b.to_pylist() for b in fulltext._posted([pa.table({"id": list(range(6)), "text": texts}).to_batches()[0]])]
    assert len(blocks) > 1 and all([(r["stem"], r["term"]) for r in b] == sorted((r["stem"], r["term"]) for r in b) for b in blocks)
    want = {(t, k, place) for k, text in enumerate(texts) for place, t in enumerate(re.findall("[a-z0-9]+", (text or "").lower()))}
    for got in ([r for b in blocks for r in b], [r.asDict() for r in made.collect()]):
        held = [(r["term"], k, place) for r in got for k, places in zip(r["ids"], r["positions"]) for place in places]
        assert len(held) == len(want) and set(held) == want and all(r["tfs"] == list(map(len, r["positions"])) for r in got)
    lengths = {r.id: r.n for r in rows.select("id", fulltext.length(F.col("text")).alias("n")).collect()}
    assert lengths == {k: sum(x[1] == k for x in want) for k in range(6)}
