"""Terms looked up where texts are read."""

from quillon.operators import ranking


def test_token_lookup(spark):
    docs = spark.createDataFrame([(5, "Red red fox"), (3, "red hen"), (3, "hen RED"), (None, "owl red"), (9, None), (8, "hen")], "id long, text string")
    asked = spark.createDataFrame([(1, "red owl, red"), (2, "hen cat")], "query long, text string")
    got = {(r.query, r.term): (r.first, r.docs) for r in ranking.token_lookup(docs, asked).collect()}
    assert got == {(1, "red"): (3, 2), (1, "owl"): (None, 0), (2, "hen"): (3, 2)}
