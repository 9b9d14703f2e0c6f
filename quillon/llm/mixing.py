"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Targets come from the sources' totals alone: weights share all words, no source above MOST times its own, found in closed
form over sources ordered by the weight at which they fill up. Blocks of BLOCK words go to sources by highest quotients
target / (2k + 1), and the words that make no whole block go likewise, as blocks of one word. A source has as many shards as
it has SHARD words, in groups of about the root of their number, and its blocks go to groups and then to shards by highest quotients over
the words that each holds; what one cannot take, because its documents would be taken more than MOST times, and what makes no whole
block goes to the next that can. In a shard a document is taken as often as the shard's quota covers it all; the rest is
met by whole blocks in a seeded hash order, the last one in part. So a source of any size is many small groups of like
size, and a mix of a few words is met to the word.

Quotients are worked out only around a party's share: with n parties and S seats a quota lies within
n * share / (2 S) + 1 of the share, so some few quotients a party are enough.

Defined results: null text has no words and takes none; null sources are one source, last in order; repeated rows are
rows, and those equal in doc_id and text are interchangeable; an empty table gives no rows; other columns are ignored.
Sources are rows of one window, a row a source whatever the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, scratch

WEIGHTS, MOST, BLOCK, SHARD, SEED = (5, 2, 1), 3, 128, 1 << 18, 7


def apportion(parties: DataFrame, group: list[str], party: list[str]) -> DataFrame:
    """parties(group, party, weight, seats) with column quota: the seats of each group by highest quotients weight / (2k + 1)."""
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    out = parties.withColumn("_sum", F.sum("weight").over(every)).withColumn("_n", F.count("*").over(every))
    out = out.withColumn("_share", F.when(F.col("_sum") > 0, F.col("weight") / F.col("_sum") * F.col("seats")).otherwise(F.lit(0.0)))
    out = out.withColumn("_room", F.ceil(F.coalesce(F.col("_n") * F.col("_share") / (2 * F.nullif("seats", F.lit(0))), F.lit(0))) + 2)
    out = out.withColumn("_base", F.greatest(F.lit(0), F.floor("_share") - F.col("_room")).cast("long")).withColumn("_bases", F.sum("_base").over(every))
    tried = out.withColumn("_k", F.explode(F.sequence("_base", (F.floor("_share") + F.col("_room")).cast("long"))))
    order = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    place = F.row_number().over(order.orderBy(F.desc(F.col("weight") / (2 * F.col("_k") + 1)), *party))
    won = (place <= F.col("seats") - F.col("_bases")) & (F.col("weight") > 0)
    tried = tried.withColumn("_won", won.cast("long"))
    keep = [c for c in parties.columns if c not in group + party]
    return tried.groupBy(*group, *party).agg(*(F.first(c).alias(c) for c in keep), (F.first("_base") + F.sum("_won")).alias("quota"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target of each source of sizes(source, size): a row a source, whatever the rows."""
    of = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))) - 1
    of = of.withColumn("w", F.get(F.array(*map(F.lit, weights)), rank % len(weights)).cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    every, before = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = (F.sum(F.col("source_size").cast("double")).over(every) - sums("cap")) / (F.sum("w").over(every) - sums("w"))
    of = of.withColumn("level", level)
    fills = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "level"))).over(every)["level"]
    return of.select("source", "source_size", F.least("cap", F.coalesce(fills * F.col("w"), F.col("cap"))).alias("target"))


def source_words(targets: DataFrame, most: int, block: int) -> DataFrame:
    """targets with columns none, key (the source, told from null) and words: what the mix takes of each source. Whole blocks go by
    highest quotients, then the remaining words."""
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    keyed = targets.withColumns({"none": F.col("source").isNull(), "key": F.coalesce("source", F.lit("")), "weight": F.col("target"), "seats": F.lit(total // block).cast("long")})
    blocks = apportion(keyed, [], ["none", "key"]).withColumn("blocks", F.col("quota") * block).drop("quota")
    rest = blocks.withColumns({"weight": F.greatest(F.lit(0.0), F.col("target") - F.col("blocks")), "seats": F.lit(total % block).cast("long")})
    rest = apportion(rest, [], ["none", "key"])
    return rest.select("none", "key", "source_size", "target", F.least(F.col("blocks") + F.col("quota"), most * F.col("source_size")).alias("words"))


def dealt(cells: DataFrame, group: list[str], party: list[str], most: int, block: int) -> DataFrame:
    """cells(group, party, held, words: of the group) with words of each cell: blocks by highest quotients over the words held, and
    what is left, in order of the parties, to those that can take more. None gets more than `most` times what it holds."""
    held = cells.withColumn("weight", F.col("held").cast("double")).withColumn("seats", F.floor(F.col("words") / block).cast("long"))
    out = apportion(held, group, party).withColumn("own", F.least(F.col("quota") * block, most * F.col("held"))).withColumn("spare", most * F.col("held") - F.col("own"))
    every = Window.partitionBy(*group)
    before = F.coalesce(F.sum("spare").over(every.orderBy(*party).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("spare"), F.col("words") - F.sum("own").over(every) - before))
    return out.withColumn("words", (F.col("own") + more).cast("long")).drop("weight", "seats", "quota", "own", "spare")


def blocks_taken(rows: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """For each block of rows(row, draw, source, size): its words, how often its document is taken whole, and the words taken beyond.
    draw is a hash of what a row is, so that reruns agree."""
    of_source = scratch(source_words(scratch(source_targets(rows, weights, most), "targets"), most, block), "quotas")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard))
    of_source = of_source.withColumn("wide", F.ceil(F.sqrt(shards)).cast("long")).withColumn("deep", F.ceil(shards / F.col("wide")).cast("long"))
    at = {"part": F.pmod(F.xxhash64("draw", F.lit(seed)), F.col("wide")), "shard": F.pmod(F.xxhash64("draw", F.lit(seed + 1)), F.col("deep"))}
    rows = rows.withColumn("none", F.col("source").isNull()).withColumn("key", F.coalesce("source", F.lit("")))
    rows = rows.join(of_source.drop("words"), ["none", "key"]).withColumns(at)
    cells = rows.groupBy("none", "key", "part", "shard").agg(F.sum("size").alias("held"))
    parts = dealt(cells.groupBy("none", "key", "part").agg(F.sum("held").alias("held")).join(of_source.select("none", "key", "words"), ["none", "key"]), ["none", "key"], ["part"], most, block)
    cells = dealt(cells.join(parts.select("none", "key", "part", "words"), ["none", "key", "part"]), ["none", "key", "part"], ["shard"], most, block)
    times = F.when(F.col("held") > 0, F.floor(F.col("words") / F.col("held"))).otherwise(0)
    cells = cells.select("none", "key", "part", "shard", times.cast("long").alias("times"), (F.col("words") - times * F.col("held")).cast("long").alias("rest"))
    cells = scratch(cells, "cells")
    cut = rows.join(cells, ["none", "key", "part", "shard"])
    cut = cut.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("size") / block) - 1))))
    cut = cut.withColumn("words", F.least(F.lit(block), F.col("size") - F.col("block") * block).cast("long"))
    order = Window.partitionBy("none", "key", "part", "shard").orderBy(F.xxhash64("draw", "block", F.lit(seed)), "draw", "size", "block", "row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(order), F.lit(0))
    return cut.withColumn("more", F.least("words", F.greatest(F.lit(0), F.col("rest") - before)).cast("long"))


def _draw(doc_id, text):
    return F.xxhash64(doc_id.cast("long"), text).alias("draw")


def sized(docs: DataFrame) -> DataFrame:
    """row, draw, doc_id, source and size (words) of each row of docs; row is fixed once it is written."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return scratch(docs.select(F.monotonically_increasing_id().alias("row"), _draw(F.col("doc_id"), text), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")), "sized")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of docs(doc_id, text, source)."""
    cut = blocks_taken(sized(docs), weights, most, block, shard, seed)
    out = cut.groupBy("row", "doc_id").agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), (F.first("times") * F.first("size") + F.sum("more")).alias("taken"))
    return out.drop("row")


def mixed_texts(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: each row as often as it is taken whole, and once more with the blocks taken
    beyond that, if any; a block taken in part counts if half of it or more is."""
    names = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in names]).alias("_doc"), _draw(F.col("doc_id"), text), F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"), F.monotonically_increasing_id().alias("_id"))
    held = scratch(held, "mixed")
    rows = held.select(F.col("_id").alias("row"), "draw", F.col("_doc.source").cast("string").alias("source"), F.col("_size").alias("size"))
    cut = blocks_taken(rows, weights, most, block, shard, seed)
    chosen = F.array_sort(F.collect_list(F.when(2 * F.col("more") >= F.greatest("words", F.lit(1)), F.col("block"))))  # of one document
    taken = cut.groupBy("row").agg(F.first("times").alias("_times"), chosen.alias("_blocks"), F.first("size").alias("_words"))
    out = held.join(taken.withColumnRenamed("row", "_id"), "_id").where("_words > 0")
    pieces = F.regexp_extract_all(F.col("_doc.text"), F.lit(rf"(?:{WORD}+[\x20\x09-\x0D]*+){{1,{block}}}"), F.lit(0))
    part = F.when(F.size("_blocks") == F.ceil(F.col("_words") / block), F.col("_doc.text")).otherwise(F.array_join(F.transform("_blocks", lambda k: F.get(pieces, k.cast("int"))), ""))
    texts = F.concat(F.when(F.col("_times") > 0, F.array_repeat(F.col("_doc.text"), F.col("_times").cast("int"))).otherwise(F.array().cast("array<string>")), F.when(F.size("_blocks") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("_text", F.explode(texts))
    values = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    return out.select(*(values[c].alias(c) if values.get(c) is not None else F.col("_doc")[c].alias(c) for c in names))
