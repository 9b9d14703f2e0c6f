"""Whitening against numpy's covariance, WAND against all scores, byte-pair encoding against the tokenizers library."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, wand, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grid(vector):
    return [math.floor(64 * c) + 1_000_000 for c in vector]


def check_whitening(rows, given):
    """rows: (vec_id, vector) that remain; given: the operator's rows."""
    listed = sorted({tuple(grid(v)) for _, v in rows})
    x = np.array(listed, object)
    n, sums = len(listed), x.sum(0)
    centred = (np.array(x * n - sums, float)) / n
    v = centred.T @ centred / n
    k = min(16, v.shape[0])
    values = np.linalg.eigh(v)[0][::-1][:k]
    assert len(given) == k * len(rows)
    by = {}
    for r in given:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    points = {}
    for i, vector in rows:
        g = grid(vector)
        deviation = sum((n * a - s) ** 2 for a, s in zip(g, sums))
        points[tuple(g)] = i
        for c in range(1, k + 1):
            for r in by[i][c]:
                assert (r.n, r.deviation) == (n, deviation if deviation < 2**63 else None)
                assert r.explained == pytest.approx(values[c - 1] / np.trace(v), rel=1e-9, abs=1e-12)
                assert r.identity_error <= 1e-4
    w = np.array([[by[points[tuple(p)]][c][0].whitened for c in range(1, k + 1)] for p in listed], float)
    live = values > 1e-9 * values[0]
    assert np.allclose((w.T @ w / n)[np.ix_(live, live)], np.eye(live.sum()), atol=1e-8)
    # projected on eigenvectors: the covariance of what is whitened with x gives them back
    vectors = (w.T @ centred / n)[live] / np.sqrt(values[live])[:, None]
    assert np.allclose(v @ vectors.T, vectors.T * values[live], atol=1e-7 * values[0])


def test_whitening(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    check_whitening([(r.vec_id, r.embedding) for r in df.collect()], whitening.whiten(df).collect())


def test_whitening_odd(spark):
    rng = random.Random(5)
    good = [(i, [rng.gauss(0, 1), rng.gauss(3, 2), 7.0, rng.gauss(-1, 0.1)]) for i in range(40)]
    good += [(100 + i, good[3][1]) for i in range(30)]  # copies count once in the fit list
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0]), (203, [1.0, float("nan"), 2.0, 3.0]), (204, [float("inf"), 1.0, 2.0, 3.0]), (205, [1e300, 0.0, 0.0, 0.0]), (206, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("x", F.lit("x")).withColumn("n", F.lit(1))
    check_whitening(good, whitening.whiten(df).collect())
    zero = [r for r in whitening.whiten(df).collect() if r.component == 4]
    assert all(r.whitened is None and r.explained == 0 for r in zero)  # one entry is the same in all rows
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id >= 200")).where("vec_id <> 206").count() == 0
    alone = whitening.whiten(df.where("vec_id = 1").withColumn("vec_id", F.lit(None).cast("long"))).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened) for r in alone] == [(None, c, 1, 0, None) for c in (1, 2, 3, 4)]
    large = [(i, [float(10**12 * (i % 3)), float(i)]) for i in range(30)]  # sums and squares beyond 64 bits
    check_whitening(large, whitening.whiten(spark.createDataFrame(large, "vec_id long, embedding array<double>")).collect())


def test_merging_is_the_whole():
    x = np.random.default_rng(1).integers(-50, 50, (300, 5)) + 1_000_000
    parts = [whitening._of_grid(p) for p in np.split(x, [7, 8, 100, 230])]
    n, sums, scatter = whitening.merged(whitening.merged(parts[0], whitening.merged(parts[1], parts[2])), whitening.merged(None, whitening.merged(parts[3], parts[4])))
    about = x - x.mean(0)
    assert n == 300 and sums == x.sum(0).tolist() and np.allclose(scatter, about.T @ about)


def all_scores(docs, items, k=20):
    found = [(i, Counter(TERM.findall((t or "").translate(ASCII)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in found:
            m, score = 75 + 25 * sum(c.values()) * n // total, 0
            for t in TERM.findall((text or "").translate(ASCII)):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("documents", [3, 8192])
def test_wand(spark, small, documents):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    expected = all_scores([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows_of(wand.search(docs, items, documents=documents)) == sorted(expected, key=repr)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_wand_odd(spark, monkeypatch, k):
    rng = random.Random(7)
    words = ["The", "the", "cat", "DOG", "éa", "Éa", "x1", "a b", "12", "rare"]
    docs = [(rng.randrange(-5, 60) if rng.random() < 0.9 else None, "".join(rng.choice(words) + rng.choice(" .,\n_") for _ in range(rng.randint(1, 30)))) for _ in range(150)]
    docs += [(500, None), (501, ""), (502, " .,-"), (503, "cat " * 50_000), *[(600 + i, "dog cat") for i in range(30)]]
    items = [(1, "the cat the dog"), (1, "rare x1"), (None, "éa Éa"), (3, None), (4, ""), (5, "absent"), (6, "absent 12 cat cat"), (7, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("s")).withColumn("rank", F.lit("r"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("query", F.lit("q"))
    expected = sorted(all_scores(docs, items, k), key=repr)
    # equal scores of null ids and repeated rows make ranks exchangeable only where the rows are equal
    assert rows_of(wand.search(df.repartition(5), asked, k, 16, 40)) == expected
    monkeypatch.setattr(wand, "QUERIES", 3)  # several blocks
    monkeypatch.setattr(wand, "AHEAD", 2)
    monkeypatch.setattr(wand, "SLICE", 64)
    assert rows_of(wand.search(df, asked, k)) == expected
    assert wand.search(df.limit(0), asked).count() == wand.search(df, asked.limit(0)).count() == 0


def test_wand_skips():
    """Most documents of a frequent term are passed over once a rare term has filled the heap."""
    common, rare = list(range(10_000)), list(range(0, 10_000, 500))
    looked = Counter()

    class Watched(list):
        def __getitem__(self, at):
            looked["n"] += 1
            return super().__getitem__(at)

    lists = [(common, Watched([1] * 10_000), 1, 1), (rare, [50] * 20, 50, 1)]
    assert sorted(wand.wand(lists, 10)) == sorted((51, d) for d in rare[:10])
    assert looked["n"] < 600


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4")


def odd_texts():
    rng = random.Random(3)
    letters = "aabbcthe ersnio'sd ll're ve.,!?<|endoftext|>éÉñΣς́ \x1c\x85  中İ0123\t\n😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    texts += ["a" * 3000, "ab" * 900 + "!" * 500, "<|endoftext|>Hi<|startoftext|> <|endoftext|", "'s 't' I'LL", "", " \n", None]
    return texts + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000)), *(f"x{chr(c)}Y{chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000)]


def test_bpe_odd(spark, library):
    texts = odd_texts()
    df = spark.createDataFrame([(k if k % 7 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("row", F.lit(1))
    expected = []
    for k, t in enumerate(texts):
        ids = ids_of(library, t or "")
        text = library.decode(ids.tolist(), skip_special_tokens=False)
        expected.append((k if k % 7 else None, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = sorted((tuple(r) for r in bpe.round_trip(df).collect()), key=repr)
    assert got == sorted(expected, key=repr)
    encoded = bpe.encode(df)
    assert sorted((r.ids for r in encoded.collect()), key=repr) == sorted((bytes(ids_of(library, t or "").tobytes()) for t in texts), key=repr)
    back = sorted(r.text for r in bpe.decode(encoded).collect())
    assert back == sorted(library.decode(ids_of(library, t or "").tolist(), skip_special_tokens=False) for t in texts)
    assert bpe.round_trip(df.limit(0)).count() == bpe.decode(encoded.limit(0)).count() == 0


def test_bpe_in_slices(library, monkeypatch):
    """Long texts in many slices, and a table of words that overflows, give the same ids."""
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    one = bpe.Bpe()
    for text in odd_texts()[:60]:
        parts = one.encode(list(bpe.sliced(text or "", 7)))
        assert b"".join(parts) == ids_of(library, text or "").tobytes()


def test_bpe_wide_spaces(library):
    """A word parted by white space beyond ASCII and one that is nothing else leave as many gaps as there are words: the words are told apart all the same."""
    one, words = bpe.Bpe(), ["é", "p\x85q", "\x85", "ñ", "\u3000x"]
    for order in itertools.permutations(words):
        learnt = one._learn([w.encode() for w in order])
        assert learnt == {w.encode(): ids_of(library, w).tobytes() for w in words}


def test_bpe_documents(spark, small, library):
    rows = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    for r in bpe.round_trip(rows).collect():
        ids = ids_of(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()


def test_merges_that_interact():
    """Where a merge's result has an earlier merge of its own, one place is merged at a time, as by a queue."""
    one = bpe.Bpe.__new__(bpe.Bpe)
    # symbols a 0, b 1, c 2, ab 3, bc 4, abc 5, abca 6; the ranks make (abc, a) come before (a, bc)
    merges = [((0, 1), 3), ((3, 2), 5), ((5, 0), 6), ((1, 2), 4), ((0, 4), 5)]
    merges = [merges[2], merges[3], merges[4]]
    one.size = 7
    keys = np.array([a * 7 + b for (a, b), _ in merges])
    order = np.argsort(keys)
    one.keys, one.rank, one.made = keys[order], np.arange(3, dtype=np.int32)[order], np.array([m for _, m in merges])
    first = np.full(7, bpe._NONE)
    for rank, ((a, b), _) in enumerate(merges):
        first[[a, b]] = np.minimum(first[[a, b]], rank)
    one.together = first[one.made] > np.arange(3)
    one.inner = one.final = np.arange(256)
    ids, counts = one.merge(np.array([0, 1, 2, 0, 1, 2, 0, 1], np.uint8), np.array([6, 2]))

    def queue(symbols):
        table = {pair: (rank, made) for rank, (pair, made) in enumerate(merges)}
        while found := [(table[p][0], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in table]:
            _, k = min(found)
            symbols = [*symbols[:k], table[symbols[k], symbols[k + 1]][1], *symbols[k + 2 :]]
        return symbols

    assert ids.tolist() == queue([0, 1, 2, 0, 1, 2]) + queue([0, 1]) and counts.tolist() == [len(queue([0, 1, 2, 0, 1, 2])), 2]


def test_stages_keep_columns_of_any_name(spark, small):
    """Names with spaces, dots and quotes, maps, and a doc_id with several texts."""
    from quillon.llm import stages

    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, words, "en", "a", 10, {"k": 1}, "x"), (2, words + " w60", "en", "a", 10, {"k": 2}, "y"), (2, "other text of five words more", "en", "a", 10, None, "z"), (2, "other text of five words more", "en", "a", 10, None, "a"), (None, words, "en", None, 10, None, "n"), (3, None, "en", "b", 0, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `my col` map<string,int>, `a.b``c` string")
    for stage in (stages.drop_toxic, stages.drop_near_copies, stages.mask_secrets, stages.mix_sources):
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        assert out.count() > 0 and stage(spark, docs.limit(0), small).count() == 0
    kept = sorted((tuple(r) for r in stages.drop_near_copies(spark, docs, small).collect()), key=repr)
    assert kept == sorted([tuple(rows[0]), (*rows[3][:6], "a"), tuple(rows[4]), tuple(rows[5])], key=repr)
    assert stages.pack_sequences(spark, docs, small).count() == 6


def test_toxicity_bound_holds(spark):
    """Repeated rows and doc_ids with two labels do not raise what is gathered."""
    from quillon.llm import toxicity

    docs = spark.createDataFrame([(i, f"text number {i} with words {'bad' if i % 2 else 'good'} word", k) for i in range(60) for k in range(9)], "doc_id long, text string, k int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, 0), (7, 0), (9, None)], "doc_id long, toxic int")
    seen, fit = [], toxicity.fit
    try:
        toxicity.fit = lambda rows: seen.append(rows) or fit(rows)
        model = toxicity.train(docs, labels, 20)
        every = toxicity.train(docs, labels)
    finally:
        toxicity.fit = fit
    assert len(seen[0]) == 20 and len(model[1]) and len(every[1])
    held = {i for i in range(60) if __import__("zlib").crc32(str(i).encode()) % 5}
    assert len(seen[1]) == len(held - {5, 7})
