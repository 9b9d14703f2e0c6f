"""Ranking over whole passages, against brute force that shares no text with the query."""

import math
import re

from quillon import catalog

PASSAGE = "Aa ab ac ad ae af zebra zinc zz 7"
DOCS = [(1, "zebra zebra and more"), (2, "aa ab unrelated"), (3, "nothing of it"), (4, "z zz zinc zebra"), (5, "7 only"), (6, "")]


def words(text):
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def test_all_terms_of_a_passage_are_searched(spark, tmp_path):
    spark.createDataFrame([(0, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, t, "s") for k, t in DOCS], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    held = {k: words(t) for k, t in DOCS if words(t)}
    mean = sum(map(len, held.values())) / len(held)
    want = {}
    for k, w in held.items():
        for term in set(words(PASSAGE)) & set(w):
            df, tf = sum(term in x for x in held.values()), w.count(term)
            want[k] = want.get(k, 0) + math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    got = {r.doc_id: r.score for r in catalog.queries()["r_bm25_topk"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 4, 5} and all(abs(got[k] - want[k]) < 1e-3 for k in want)
    terms = {r.term for r in catalog.queries()["j23_token_lookup"](spark, str(tmp_path)).collect()}
    assert terms == {"aa", "ab", "zebra", "zinc", "zz", "7"}
