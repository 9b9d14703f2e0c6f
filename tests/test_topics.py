"""Topics by votes: a search for many words at once finds as much as one for each."""

import re

from pyspark.sql import functions as F

from quillon.functions import fixed, text
from quillon.queries import texts

OF = {"meeting": ("a b", "b c", "c", "C", "d d", "+e", "e", "f/g", "g-h", "ci", "cicd"), "none": ()}
TEXTS = ["a b c", "A B b c C", "d d d", "+e x+e e", "f/g-h g-h", "ci/cd cicd ci", "x a b", None, "", "ab cicdx _ci -ci"]


def test_words_that_meet_are_searched_apart(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, note string").withColumn("v", text._topic_votes(F.col("note"), OF)).collect()
    for r in rows:
        want = sum(len(re.findall(rf"\b{re.escape(w)}\b", r.note or "", flags=re.I | re.A)) for w in OF["meeting"])
        assert {x.label: -x.less for x in r.v} == ({"meeting": want} if want else {}), r.note
    assert sorted(w for of in text._apart(OF["meeting"]) for w in of) == sorted(OF["meeting"])


def test_topics_are_searched_once_for_each_list(spark, small):
    plan = texts.f22_topics(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") <= sum(len(text._apart(words)) for words in fixed.TOPICS.values()) < 20
