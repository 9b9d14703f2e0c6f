"""Conflict pairs against brute force over all pairs, texts with edited first words among them."""

import random
import re

from quillon import catalog


def test_pairs_with_different_first_words(spark, tmp_path):
    rng, rows = random.Random(3), []
    for k in range(60):
        words = [f"w{rng.randrange(40)}_{j}" for j in range(rng.choice((1, 2, 3, 10, 20, 33)))]
        for edits in (0, 0, 1, 2, 4):
            own = list(words)
            for j in range(min(edits, len(own))):
                own[j] = f"Edit{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(own), rng.choice(("en", "de", "", None)), rng.choice(("a", "b", None))))
    rows += [(len(rows), "", "en", "a"), (len(rows) + 1, None, "en", "b"), (len(rows) + 2, "to of a", "en", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = [{w for w in re.findall("[a-z0-9_]+", (r[1] or "").lower()) if len(w) > 2} for r in rows]
    want = {}
    for a, x in enumerate(rows):
        for b, y in enumerate(rows[:a]):
            both = len(sets[a] & sets[b])
            if (x[2] or "global") == (y[2] or "global") and x[3] != y[3] and both and 10 * both >= 7 * len(sets[a] | sets[b]):
                want[b, a] = round(both / len(sets[a] | sets[b]), 4)
    got = catalog.queries()["j18_conflict_pairs"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.jaccard for r in got} == want
    assert any(rows[a][1].split()[0] != rows[b][1].split()[0] for a, b in want)


def test_moves_each_class_once(spark, tmp_path):
    """Of many copies one set of words is kept, and only pairs that can be near are written."""
    from quillon import scratch
    from quillon.operators import search

    rng = random.Random(5)
    texts = [" ".join(f"word{rng.randrange(60)}" for _ in range(25)) for _ in range(120)]
    rows = [(k, texts[k % 120], "en", f"s{k % 7}") for k in range(1200)]
    at = []
    kept, scratch.folder = scratch.folder, lambda s, tag: at.append(f"file://{tmp_path}/{tag}") or at[-1]
    try:
        pairs = search.like_pairs(spark.createDataFrame(rows, "id long, text string, space string, source string")).count()
    finally:
        scratch.folder = kept
    sets = sorted({tuple(sorted(set(t.split()))) for t in texts})
    near = sum(10 * len(set(x) & set(y)) >= 7 * len(set(x) | set(y)) for k, x in enumerate(sets) for y in sets[:k])
    met = spark.read.parquet(f"{at[0]}/met").count()
    assert spark.read.parquet(f"{at[0]}/classes").count() == len(sets)
    assert near <= met < len(sets) * (len(sets) - 1) / 8 and pairs >= 120 * 9 * 10 / 2 * 6 / 7 - 120 * 10


def test_large_sets_that_share_few_words_are_not_written_as_pairs(spark, tmp_path):
    """Signatures grow with the sets, so of large sets whose rarer words meet only those that are near are written and held against each other."""
    from quillon import scratch
    from quillon.operators import search

    rng = random.Random(8)
    texts = [rng.sample([f"word{k}" for k in range(6000)], rng.choice((600, 1000, 1400))) for _ in range(50)]
    texts += [t[:-40] + [f"edit{k}_{j}" for j in range(30)] for k, t in enumerate(texts[:8])]
    at = []
    kept, scratch.folder = scratch.folder, lambda s, tag: at.append(f"file://{tmp_path}/{tag}") or at[-1]
    try:
        got = search.like_pairs(spark.createDataFrame([(k, " ".join(t), "en", f"s{k}") for k, t in enumerate(texts)], "id long, text string, space string, source string")).collect()
    finally:
        scratch.folder = kept
    assert {(r.a, r.b): r.jaccard for r in got} == {(k, 50 + k): round((len(texts[k]) - 40) / (len(texts[k]) + 30), 4) for k in range(8)}
    assert spark.read.parquet(f"{at[0]}/met").count() == 8
