"""Entities and their neighbourhood: mentions in queries, expansion, hits from the graph, lineage, chains of checkpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import fixed, text
from . import ranking

# Words of a phrase, entities a phrase may name, mentions from which a single word must be the name, most items of a
# neighbourhood, hits made of the graph, weight of the graph, most lineage edges shown.
PHRASE_WORDS, NAMED_BY_PHRASE, MANY_MENTIONS, MOST_ITEMS, MOST_SYNTHETIC, GRAPH_WEIGHT, MOST_EDGES = 3, 3, 20, 50, 20, 0.3, 200


# Kinds of entities that are kept for good.
DURABLE_KINDS = ("person", "host", "server", "service", "credential", "organization", "cluster", "database", "network", "user")
#: Texts of entity searches that are broadcast at a time.
SEARCHED = 200


def _grams(value: Column, n: int) -> Column:
    return F.when(F.char_length(value) >= n, F.transform(F.sequence(F.lit(1), F.char_length(value) - (n - 1)), lambda k: F.substring(value, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def mentions(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query, id): entities(id, name, mentions) that windows of three, two and one words of queries(query, text) name (J25). A phrase
    names the most mentioned entities whose lower-cased name holds it. Phrases meet names over their first three letters, or
    two, so no phrase is held against all names."""
    words = text.blank_parts(F.lower("text"))
    windows = [_windows(n) for n in range(PHRASE_WORDS, 0, -1)]
    phrases = queries.select("query", words.alias("w")).select("query", F.explode(F.concat(*windows)).alias("p")).select("query", "p.n", "p.phrase").distinct()
    phrases = phrases.where((F.char_length("phrase") >= 2) & ~((F.col("n") == 1) & F.col("phrase").isin(fixed.ENTITY_STOP_WORDS)))
    asked = phrases.select("phrase").distinct().withColumn("key", F.substring("phrase", 1, 3))
    names = entities.select("id", F.lower("name").alias("name"), "mentions")
    keyed = names.withColumn("key", F.explode(F.array_distinct(F.concat(_grams(F.col("name"), 3), _grams(F.col("name"), 2)))))
    found = asked.join(keyed, "key").where(F.contains("name", "phrase"))
    place = F.row_number().over(Window.partitionBy("phrase").orderBy(F.desc("mentions"), "id"))
    found = found.withColumn("place", place).where(F.col("place") <= NAMED_BY_PHRASE).select("phrase", "id", "name", "mentions")
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\w\s-]", ""))
    specific = (F.col("n") > 1) | (F.col("mentions") <= MANY_MENTIONS) | (plain("name") == plain("phrase"))
    return phrases.join(found, "phrase").where(specific).select("query", "id").distinct()


def _windows(n: int) -> Column:
    starts = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", k + 1, n), " ").alias("phrase")))


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 1, most: int = MOST_ITEMS) -> DataFrame:
    """(query, id, hop): what seeds(query, id) reach over edges(a, b), either way, within `depth` hops, each once; the nearest `most`."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    seen = seeds.select("query", "id").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, depth + 1):
        reached = front.join(both, F.col("id") == F.col("a")).select("query", F.col("b").alias("id")).distinct()
        front = reached.join(seen.select("query", "id"), ["query", "id"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.union(front)
    place = F.row_number().over(Window.partitionBy("query").orderBy("hop", "id"))
    return seen.withColumn("place", place).where(F.col("place") <= most).drop("place")


def with_graph(hits: DataFrame, items: DataFrame, weight: float = GRAPH_WEIGHT, most: int = MOST_SYNTHETIC) -> DataFrame:
    """hits(query, id, file, score, rank) moved by items(query, file, text): each item of a hit's file lifts the file's first hit by half the
    weight, and their first 300 characters are its context, in order of text; items of no hit's file become hits without an id, texts told apart by 80 characters, the
    first `most` (J26). Gives (query, id, file, score, text, context)."""
    items = items.where(F.col("text") != "")
    first = hits.groupBy("query", "file").agg(F.min("rank").alias("rank"))
    lifted = items.join(first, ["query", "file"]).groupBy("query", "file", "rank").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.substring("text", 1, 300))).alias("context"))
    moved = hits.join(lifted, ["query", "file", "rank"], "left").withColumn("score", F.col("score") + F.coalesce("n", F.lit(0)) * weight * 0.5)
    others = items.join(first, ["query", "file"], "left_anti").groupBy("query", F.substring("text", 1, 80).alias("head")).agg(F.min(F.struct("text", "file")).alias("x"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("head"))
    made = others.withColumn("place", place).where(F.col("place") <= most).select("query", F.lit(None).cast(hits.schema["id"].dataType).alias("id"), "x.file", F.lit(weight).alias("score"), F.substring("x.text", 1, 500).alias("text"), F.array().cast("array<string>").alias("context"))
    return moved.select("query", "id", "file", "score", F.lit(None).cast("string").alias("text"), F.coalesce("context", F.array().cast("array<string>")).alias("context")).union(made)


def lineage(edges: list[DataFrame], most: int = MOST_EDGES) -> DataFrame:
    """One row for each memory of edges(memory, kind, source, at), of several kinds: how many edges, of which kinds, and the newest ones up to `most`."""
    every = reduce(DataFrame.unionByName, edges)
    place = F.row_number().over(Window.partitionBy("memory").orderBy(F.desc("at"), "kind", "source"))
    shown = every.withColumn("place", place).where(F.col("place") <= most)
    return shown.groupBy("memory").agg(F.count("*").alias("edge_count"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("sources"), F.max("at").alias("newest"))


def replay(nodes: DataFrame, leaves: DataFrame, depth: int = 8) -> DataFrame:
    """(leaf, step, id): the chain of parents of each leaf over nodes(id, parent), from the root on, up to `depth` nodes; a chain that comes
    back to a node of its own has one row, with step null (Z6). A leaf that is no node gives none."""
    state = leaves.select("leaf").join(nodes.select(F.col("id").alias("leaf"), "parent"), "leaf").select("leaf", F.array("leaf").alias("path"), F.col("parent").alias("next"), F.lit(False).alias("cycle"))
    up = nodes.select(F.col("id").alias("node"), F.col("parent").alias("above"))
    for _ in range(depth - 1):
        at = state.join(up, F.col("next") == F.col("node"), "left")
        again = F.col("cycle") | F.coalesce(F.array_contains("path", F.col("next")), F.lit(False))
        go = ~again & F.col("node").isNotNull()
        state = at.select("leaf", F.when(go, F.array_append("path", F.col("next"))).otherwise(F.col("path")).alias("path"), F.when(go, F.col("above")).alias("next"), again.alias("cycle"))
    chain = state.where(~F.col("cycle")).select("leaf", F.posexplode(F.reverse("path")).alias("step", "id"))
    return chain.union(state.where("cycle").select("leaf", F.lit(None).cast("int"), F.lit(None).cast(nodes.schema["id"].dataType)))


def canonical(aliases: DataFrame) -> DataFrame:
    """(name, entity) of every name in aliases(name, alias_of): chains of aliases end at one entity, the name in their group that is no alias itself. Of several such
    names, or in a ring of aliases that has none, the least stands for all. Names that are null and names that are their own alias tell nothing.

    Rounds of least neighbours and of jumps over what is known halve the way to the end each time; each is written, so no plan grows with a chain."""
    spark = aliases.sparkSession
    said = aliases.where("name is not null and alias_of is not null").select(F.col("name").cast("string"), F.col("alias_of").cast("string").alias("of"))
    names = said.select(F.col("name").alias("v")).union(said.select("of")).distinct()
    roots = names.join(said.where("name <> of").select(F.col("name").alias("v")).distinct(), "v", "left_anti").withColumn("root", F.lit(0))
    # names are compared by whether they are roots and then by themselves, so a group's least is its entity
    rank = names.join(roots, "v", "left").select("v", F.struct(F.coalesce("root", F.lit(1)).alias("late"), F.col("v").alias("name")).alias("at"))
    both = said.union(said.select("of", "name")).where("name <> of").distinct()
    root = scratch.folder(spark, "aliases")
    both.write.parquet(f"{root}/edges")
    rank.write.parquet(f"{root}/0")
    edges, number, changed = spark.read.parquet(f"{root}/edges"), 0, 1
    while changed:
        at = spark.read.parquet(f"{root}/{number}")
        near = edges.join(at, F.col("of") == F.col("v")).groupBy("name").agg(F.min("at").alias("near"))
        least = at.join(near, F.col("v") == F.col("name"), "left").select("v", F.col("at").alias("was"), F.least("at", F.coalesce("near", "at")).alias("least"))
        on = at.select(F.col("v").alias("by"), F.col("at").alias("jump"))
        jumped = least.join(on, F.col("least.name") == F.col("by")).select("v", F.least("least", "jump").alias("at"), (F.least("least", "jump") != F.col("was")).alias("moved"))
        number += 1
        jumped.write.parquet(f"{root}/{number}")
        changed = spark.read.parquet(f"{root}/{number}").where("moved").limit(1).count()
    return spark.read.parquet(f"{root}/{number}").select(F.col("v").alias("name"), F.col("at.name").alias("entity"))


def extracted(entities: DataFrame, facts: DataFrame, relations: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an extraction adds to the graph (M5): entities(name, kind, at), facts(name, fact, file, valid_from) and relations(source, target, kind, at), names resolved by aliases.

    Gives entities (name, kind, mentions, retention, first_seen, last_seen), of both ends of relations and of facts too; facts (name, fact, retention, valid_from: that of the path, if none is
    given); relations (source, target, kind, mentions, confidence). An entity is durable if any of its kinds is; names are told apart by their letters' case no more."""
    known = canonical(aliases.select(F.lower("name").alias("name"), F.lower("alias_of").alias("alias_of"))).withColumnRenamed("name", "_name")

    def resolved(rows: DataFrame, column: str) -> DataFrame:
        rows = rows.withColumn(column, F.lower(F.trim(column))).where(F.col(column) != "")
        return rows.join(known, F.col(column) == F.col("_name"), "left").withColumn(column, F.coalesce("entity", column)).drop("_name", "entity")

    entities, facts, relations = resolved(entities, "name"), resolved(facts, "name").where(F.trim("fact") != ""), resolved(resolved(relations, "source"), "target")
    seen = entities.select("name", "kind", "at").union(facts.select("name", F.lit(None).cast("string"), F.lit(None).cast("timestamp")))
    for end in ("source", "target"):
        seen = seen.union(relations.select(end, F.lit(None).cast("string"), "at"))
    durable = F.max(F.coalesce(F.lower("kind").isin(*DURABLE_KINDS), F.lit(False)).cast("int")) == 1
    own = seen.groupBy("name").agg(F.min("kind").alias("kind"), F.count("*").alias("mentions"), F.when(durable, "durable").otherwise("standard").alias("retention"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    of_path = F.nullif(F.regexp_extract("file", r"\b(\d{4}-\d{2}-\d{2})\b", 1), F.lit(""))
    said = facts.join(own.select("name", "retention"), "name").select("name", "fact", "retention", F.coalesce(F.nullif(F.trim("valid_from"), F.lit("")), of_path).alias("valid_from")).distinct()
    met = relations.groupBy("source", "target", "kind").agg(F.count("*").alias("mentions")).withColumn("confidence", F.round(F.least(F.lit(1.0), 0.9 + 0.1 * F.col("mentions")), 2))
    return own, said, met


def find_entities(entities: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query, name, place) of entities(name, aliases, mentions) whose name, or one of whose aliases, holds the text of queries(query, text), in any case; the most mentioned first
    (P18). queries are few and are broadcast, SEARCHED at a time."""
    out = []
    asked = queries.where("trim(text) <> ''").select("query", F.lower("text").alias("text"), F.trim(F.regexp_replace(F.lower("text"), r"[^\w\s-]", "")).alias("plain"))
    for block in ranking._blocks(asked.toLocalIterator(), lambda _: 1, SEARCHED):
        texts = F.array(*[F.struct(F.lit(r.query).alias("query"), F.lit(r.text).alias("text"), F.lit(r.plain).alias("plain")) for r in block])
        held = lambda q: F.contains(F.lower("name"), q["text"]) | ((q["plain"] != "") & F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), q["plain"])))
        out.append(entities.select("name", "mentions", F.explode(F.filter(texts, held)).alias("q")).select("q.query", "name", "mentions"))
    hits = reduce(DataFrame.union, out) if out else entities.select(F.lit(0).cast("long").alias("query"), "name", "mentions").limit(0)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("mentions"), "name"))
    return hits.withColumn("place", place).where(F.col("place") <= limit).select("query", "name", "place")
