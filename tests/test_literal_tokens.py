"""Frequent literal tokens."""

from quillon.operators import search


def test_a_frequent_literal_token_is_few_rows(spark):
    docs = spark.createDataFrame([(k, f"at 10.0.0.1 and ABC-{1000 + k % 3}" if k % 4 else "at 10.0.0.1") for k in range(4000)], "id long, text string").repartition(4)
    asked = spark.createDataFrame([("10.0.0.1",), ("ABC-1001",), ("none",)], "token string")
    found = search.first_holding(docs, asked, 20)
    assert {(r.id, r.token) for r in found.collect()} == {(k, "10.0.0.1") for k in range(20)} | {(k, "ABC-1001") for k in [k for k in range(4000) if k % 4 and k % 3 == 1][:20]}
    queries = spark.createDataFrame([(k, "see ABC-1001 or 10.0.0.1") for k in range(50)], "query long, text string")
    got = search.literal_hits(docs, queries).collect()
    assert len(got) == 500 and {r.id for r in got} == set(range(10))
