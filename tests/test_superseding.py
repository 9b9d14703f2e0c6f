"""Superseding forms no rows of words and pairs."""

from quillon.operators import memory


def test_superseding_counts_no_pairs(spark):
    rows = [(k, k % 3, f"Fact w{k % 2} w{k % 5} w{k % 7} a") for k in range(60)] + [(100, 1, ""), (101, 1, None), (102, None, "Fact w0")]
    out = memory.supersede(spark.createDataFrame(rows, "id long, entity long, fact string"))
    sets = {r[0]: {w for w in (r[2] or "").lower().split() if len(w) > 1} for r in rows}
    want = {r[0]: min((o[0] for o in rows if o[1] == r[1] is not None and o[0] > r[0] and sets[r[0]] and len(sets[r[0]] & sets[o[0]]) >= memory.SUPERSEDES * len(sets[r[0]])), default=None) for r in rows}
    assert {r.id: r.superseded_by for r in out.collect()} == want and any(want.values())
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()  # no row for each word, and so none for each pair and word
