"""Quality rules with cross-document line frequency, with DataFrame functions only.

A document's own measures come from one pass. Then each host's normalised lines are hashed and counted by the number of
different documents (doc_ids, exact copies too; a row without an id is one of its own) that hold them; lines in more
documents than a limit, the same for every host, are removed, and a document is rejected if too few of its words are left. The host is the source.

Defined results: null text is empty and fails; a document of under eight words has no repeated windows; repeated rows
each get their measures; null sources are one host; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, scratch

WINDOW, FEWEST_WORDS, MOST_REPEATED = 8, 20, 30
#: A line is removed in a host where more documents than this hold it, however large the host is.
LINE_DOCS = 30
#: A document is depleted if fewer words than FEWEST_WORDS or a smaller share than this are left.
LEFT_SHARE = 0.2


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words found twice or more."""

    def of_hashes(windows: Column) -> Column:
        def covered(order: Column) -> Column:
            twice = F.filter(order, lambda s, k: (F.get(order, k - 1)["h"] == s["h"]) | (F.get(order, k + 1)["h"] == s["h"]))
            places = F.array_sort(F.transform(twice, lambda s: s["k"]))
            return _let(places, lambda at: F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

        order = F.array_sort(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(order, covered))

    hashes = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda k: F.xxhash64(F.slice(h, k, WINDOW)))
    count = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(hashes(h), of_hashes))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(count).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host, content and the per-document measures, with an array of each wordy line's hash and words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), text.alias("text"))
    docs = docs.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    docs = docs.withColumn("lines", lines).withColumn("n_repeat_words", repeated_words(F.col("words")))
    normal = lambda x: F.lower(F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    return docs.select(
        "doc_id",
        "host",
        F.unhex(F.md5("text")).alias("content"),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform("lines", lambda x: F.struct(F.xxhash64(normal(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n"))).alias("lines"),
    )


def quality(docs: DataFrame, line_docs: int = LINE_DOCS, left_share: float = LEFT_SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and n_left (words outside removed
    lines) of each row of docs(doc_id, text, source)."""
    rows = scratch(measures(docs), "measures")
    texts = scratch(rows.groupBy("host", "content").agg(F.first("lines").alias("lines")), "lines")  # lines have equal contents
    held = rows.select("host", "doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).groupBy("host", "h")
    docs_of = F.count_distinct("doc_id") + F.sum(F.col("doc_id").isNull().cast("long"))
    common = held.agg(docs_of.alias("n")).where(F.col("n") > line_docs).select("host", "h")
    gone = texts.select("host", "content", F.explode("lines").alias("line")).select("host", "content", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    gone = gone.join(common, ["host", "h"]).groupBy("host", "content").agg(F.sum("n").alias("gone"))
    out = rows.drop("lines").join(gone, ["host", "content"], "left").withColumn("n_left", (F.col("n_words") - F.coalesce("gone", F.lit(0))).cast("long"))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = (F.col("n_left") < FEWEST_WORDS) | (F.col("n_left") < left_share * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left")
