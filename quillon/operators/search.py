"""Searches that need more than a join on equal keys: literal substrings, opposing facts, conflicting vectors, similar names."""

from __future__ import annotations

import difflib
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text
from ..functions.fixed import OPPOSING
from ..ship import ship
from . import ranking

#: Literal tokens that are sought at a time.
TOKENS_AT_A_TIME = 200_000
# Literal tokens of a query that are searched, hits of a query, likeness and number of suggested names.
TOKENS_SEARCHED, LITERAL_HITS, SUGGEST_FROM, SUGGESTED = 3, 10, 0.4, 3

#: Frequent words whose order by frequency is broadcast; others come before them. Words of prefixes that a bucket has about, and buckets at least.
FREQUENT, BUCKET, BUCKETS = 50_000, 1_000_000, 12
#: Meetings that are looked at together, and 64 bits of signatures; classes in pairs that are broadcast.
PAIRS, SIGNS, BROADCAST_CLASSES = 1_000_000, 500_000, 1_000_000

_WORD = re.compile("[a-z0-9_]{3,}")
_FOUND = pa.schema([("id", pa.int64()), ("token", pa.string())])
_PREFIXES = pa.schema([("bucket", pa.int32()), ("class", pa.int64()), ("space", pa.int64()), ("n", pa.int64()), ("sign", pa.binary()), ("held", pa.binary())])


def _holding(tokens: list[str]):
    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for token in tokens:
            automaton.add_word(token, token)
        automaton.make_automaton()
        for batch in batches:
            ids, found = [], []
            for id_, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = sorted({t for _, t in automaton.iter(value.as_py() or "")})
                ids += [id_] * len(held)
                found += held
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], schema=_FOUND)

    return run


def holding(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, token): docs(id, text) that hold tokens(token) as they are, one pass over the texts for each block of tokens."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("id").cast("long"), F.col("text").cast("string"))
    asked = (r.token for r in tokens.where("token <> ''").select("token").distinct().toLocalIterator())
    parts = [rows.mapInArrow(_holding(block), "id long, token string") for block in ranking._blocks(asked, lambda _: 1, TOKENS_AT_A_TIME)]
    return ranking._union(parts, docs.sparkSession.createDataFrame([], "id long, token string"))


def _first_holding(tokens: list[str], most: int):
    """The first `most` ids that hold each token, of a task's rows."""

    def run(batches):
        held: dict[str, list[int]] = {}
        for batch in _holding(tokens)(batches):
            for id_, token in zip(*(c.to_pylist() for c in batch.columns)):
                ids = held.setdefault(token, [])
                ids.append(id_)
                if len(ids) >= 16 * most:
                    held[token] = sorted(set(ids))[:most]
        for token, ids in held.items():
            ids = sorted(set(ids))[:most]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([token] * len(ids), pa.string())], schema=_FOUND)

    return run


def first_holding(docs: DataFrame, tokens: DataFrame, most: int) -> DataFrame:
    """(id, token): the first `most` ids of docs(id, text) that hold each of tokens(token). Tasks hand on their first ones, so a frequent token is no more
    rows than tasks x `most`. Rows with a null id are left out."""
    ship(docs.sparkSession)
    rows = docs.where("id is not null").select(F.col("id").cast("long"), F.col("text").cast("string"))
    asked = (r.token for r in tokens.where("token <> ''").select("token").distinct().toLocalIterator())
    parts = [rows.mapInArrow(_first_holding(block, most), "id long, token string") for block in ranking._blocks(asked, lambda _: 1, TOKENS_AT_A_TIME)]
    found = ranking._union(parts, docs.sparkSession.createDataFrame([], "id long, token string")).distinct()
    place = F.row_number().over(Window.partitionBy("token").orderBy("id"))
    return found.withColumn("nth", place).where(F.col("nth") <= most).select("id", "token")


def literal_hits(docs: DataFrame, queries: DataFrame, most: int = LITERAL_HITS) -> DataFrame:
    """(query, id, score): docs that hold one of the first TOKENS_SEARCHED literal tokens of queries(query, text), once each, the first `most` by
    token and id (R6). Only each token's first ids are read: where the tokens before one have fewer than `most` hits, they take at most so many of its first
    ids, so that twice as many leave `most`."""
    asked = queries.select("query", F.posexplode(F.slice(text.literal_tokens(F.col("text")), 1, TOKENS_SEARCHED)).alias("place", "token"))
    found = first_holding(docs, asked, 2 * most).join(asked, "token").groupBy("query", "id").agg(F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("place", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("query", "id", F.lit(0.0).alias("score"))


def opposed(facts: DataFrame) -> DataFrame:
    """(entity, a, b, trigger): facts(id, entity, agent, fact) of one entity and different agents of which one holds a keyword and the other its
    opposite, with the first such pair of keywords (J17, F15)."""
    said = F.lower(F.coalesce("fact", F.lit("")))
    sides = F.array(*[F.struct(F.lit(k).alias("pair"), F.lit(side).alias("side"), F.contains(said, F.lit(word)).alias("held")) for k, pair in enumerate(OPPOSING) for side, word in enumerate(pair)])
    rows = facts.select("id", "entity", "agent", F.explode(F.filter(sides, lambda x: x["held"])).alias("x")).select("id", "entity", "agent", "x.pair", "x.side")
    a, b = rows.where("side = 0"), rows.where("side = 1").select(F.col("id").alias("other"), "entity", "pair", F.col("agent").alias("by"))
    met = a.join(b, ["entity", "pair"]).where((F.col("id") != F.col("other")) & ~F.col("agent").eqNullSafe(F.col("by")))
    first = met.groupBy("entity", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.min("pair").alias("pair"))
    names = F.array(*[F.lit("/".join(p)) for p in OPPOSING])
    return first.select("entity", "a", "b", F.get(names, F.col("pair")).alias("trigger"))


def _conflicts(queries: list, least: float, most: int):
    """Of rows (id, vector, namespace, agent) the nearest ones of each query's namespace that are of another agent."""
    spaces, agents = ({v: k for k, v in enumerate(dict.fromkeys(r[at] for r in queries))} for at in ("namespace", "agent"))
    space, agent = np.array([spaces[r.namespace] for r in queries]), np.array([agents[r.agent] for r in queries])
    matrix = np.array([r.vector for r in queries], float)
    matrix /= np.maximum(np.sqrt((matrix * matrix).sum(1, keepdims=True)), 1e-300)

    def run(batches):
        top, every = ranking.Top(np.array([r.query for r in queries], np.int64), most), np.arange(len(queries))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.asarray(part.column(1).flatten(), float).reshape(part.num_rows, -1)
                length = np.sqrt((x * x).sum(1))
                scores = (matrix @ x.T) / np.where(length > 0, length, np.inf)
                of_space, of_agent = (np.array([known.get(v, -1) for v in part.column(c).to_pylist()]) for c, known in ((2, spaces), (3, agents)))
                hit = (space[:, None] == of_space) & (agent[:, None] != of_agent) & (length > 0) & (scores >= least)
                top.extend(every, part.column(0).to_numpy(zero_copy_only=False), scores, hit)
        query, ids, scores = top.columns()
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids, pa.int64()), pa.array(scores)], schema=ranking._HITS)

    return run


def vector_conflicts(new: DataFrame, held: DataFrame, least: float, most: int = 20) -> DataFrame:
    """(query, id, score): the nearest vectors of held(id, vector, namespace, agent) of another agent in the namespace of new(query, vector, namespace,
    agent), `least` or nearer (J20). Null is a namespace, and an agent, of its own. One pass for each block of queries, however many agents they have."""
    ship(new.sparkSession)
    kinds = [F.col("vector").cast("array<double>").alias("vector"), F.col("namespace").cast("string"), F.col("agent").cast("string")]
    asked = new.where("vector is not null").select(F.col("query").cast("long"), *kinds).toLocalIterator()
    rows = held.where("vector is not null and id is not null").select(F.col("id").cast("long"), *kinds)
    out = [rows.mapInArrow(_conflicts(block, least, most), ranking._HIT_KINDS) for block in ranking._blocks(asked, lambda r: len(r.vector), ranking.NUMBERS_AT_A_TIME)]
    return ranking.ranked(ranking._union(out, new.sparkSession.createDataFrame([], ranking._HIT_KINDS)), most).select("query", "id", "score")


def suggestions(asked: DataFrame, names: DataFrame, least: float = SUGGEST_FROM, most: int = SUGGESTED) -> DataFrame:
    """(asked, name, place): the names most like each of asked(asked), by the ratio of matching blocks (P16). names(name) is a list of
    namespaces: it is broadcast, TOKENS_AT_A_TIME of them at a time."""
    ship(asked.sparkSession)
    schema = pa.schema([("asked", pa.string()), ("name", pa.string()), ("ratio", pa.float64())])

    def near(held: list[str]):
        def run(batches):
            for batch in batches:
                rows = []
                for value in batch.column(0).to_pylist():
                    ratios = np.array([difflib.SequenceMatcher(None, (value or "").lower(), n.lower()).ratio() for n in held])
                    rows += [(value, held[k], float(ratios[k])) for k in np.lexsort((held, -ratios))[:most] if ratios[k] >= least]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 3, schema)], schema=schema)

        return run

    every = (r.name for r in names.where("name is not null").select("name").distinct().toLocalIterator())
    parts = [asked.select(F.col("asked").cast("string")).distinct().mapInArrow(near(block), "asked string, name string, ratio double") for block in ranking._blocks(every, lambda _: 1, TOKENS_AT_A_TIME)]
    out = ranking._union(parts, asked.sparkSession.createDataFrame([], "asked string, name string, ratio double"))
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("ratio"), "name"))
    return out.withColumn("place", place).where(F.col("place") <= most)


def _word_sets(batches):
    """Rows (id, space, source, lowered text) with the sorted words of three letters or more, if any, and 128 bits of them and the space."""
    for batch in batches:
        kept, words, marks = [], [], []
        for row, (space, value) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3))):
            if found := sorted(set(_WORD.findall(value.as_py() or ""))):
                kept.append(row)
                words.append(" ".join(found))
                marks.append(hashlib.sha256(f"{words[-1]}\n{space}".encode()).digest()[:16])
        rest = batch.select(["id", "space", "source"]).take(pa.array(kept, pa.int32()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(words, pa.string()), pa.array(marks, pa.binary())], names=["id", "space", "source", "words", "of"])


def _shared(batches):
    for batch in batches:
        common, both = [], []
        for a, b in zip(batch.column(2), batch.column(3)):  # one pair's sets at a time
            x, y = set(a.as_py().split(" ")), set(b.as_py().split(" "))
            common.append(len(x & y))
            both.append(len(x) + len(y))
        common, both = pa.array(common, pa.int32()), pa.array(both, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), common, both], names=["class_a", "class_b", "common", "both"])


def _prefixes(place: dict[str, int], buckets: int):
    """Of rows (class, space, words) those words, rarest first, of which two sets with a Jaccard similarity of 0.7 share one: a row for each bucket of words that
    holds some of them, with their marks and then their places, and with the set's size and signature."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, columns = batch.slice(at, 256), [[] for _ in _PREFIXES]
                for class_, space, words in zip(*(part.column(c).to_pylist() for c in range(3))):
                    words = words.split(" ")
                    marks = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words))
                    size = max(64, 1 << (len(words) * 5 // 4 - 1).bit_length())
                    bits = np.zeros(size, np.uint8)
                    bits[marks % size] = 1
                    wanted = 3 * len(words) // 10 + 1
                    first = marks[sorted(range(len(words)), key=lambda k: (place.get(words[k], -1), words[k]))[:wanted]]
                    order = np.argsort(first % buckets, kind="stable")
                    bucket, begins = np.unique(first[order] % buckets, return_index=True)
                    held = [np.r_[first[one], one.astype(np.uint32) + np.uint32(1)].tobytes() for one in np.split(order, begins[1:])]
                    same = (class_, zlib.crc32(space.encode()), len(words), np.packbits(bits).tobytes())
                    for column, values in zip(columns, (bucket.tolist(), *([x] * len(bucket) for x in same), held)):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PREFIXES)], schema=_PREFIXES)

    return run


def _meetings(key: np.ndarray, n: np.ndarray):
    """Pairs of places of equal keys whose sizes n allow the similarity, PAIRS and those of one place at a time; the rows are sorted by key and size, the smaller size comes first."""
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]]) * (2 * int(n.max(initial=0)) + 1)
    last = np.searchsorted(group + n, group + 10 * n // 7, "right")
    each = last - np.arange(len(key)) - 1
    ends = np.cumsum(each)
    at = 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - each[at] + PAIRS, "right")))
        a = np.repeat(np.arange(at, to), each[at:to])
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.r_[0, np.cumsum(each[at:to])[:-1]], each[at:to])
        at = to


def _met(table: pa.Table) -> pa.Table:
    """(class_a, class_b) of a bucket's prefixes that share a word there, and whose sizes, places and signatures allow the similarity, each once."""
    class_, space, n = (table.column(c).to_numpy() for c in ("class", "space", "n"))
    signs, held = table.column("sign").to_pylist(), table.column("held").to_pylist()
    each = np.fromiter((len(h) // 8 for h in held), np.int64, len(held))
    row, key, place = np.repeat(np.arange(len(n)), each), *(np.concatenate([np.frombuffer(h, np.uint32).reshape(2, -1)[k] for h in held]).astype(np.int64) for k in (0, 1))
    key += (space[row] - 2**31) << 32
    order = np.lexsort((n[row], key))
    row, key, place = row[order], key[order], place[order]
    # a signature is compared in the size of the smaller set's; that of the other set is as long, or twice as long and folded
    size, levels, at = np.fromiter((len(s) // 8 for s in signs), np.int64, len(signs)), {}, np.zeros((2, len(n)), np.int64)
    for level in np.unique(size).tolist():
        same, twice = np.flatnonzero(size == level), np.flatnonzero(size == 2 * level)
        own = np.frombuffer(b"".join(signs[k] for k in same), np.uint64).reshape(-1, level)
        folded = np.bitwise_or.reduce(np.frombuffer(b"".join(signs[k] for k in twice), np.uint64).reshape(-1, 2, level), 1)
        at[0, same], at[1, twice] = np.arange(len(same)), len(same) + np.arange(len(twice))
        levels[level] = np.concatenate([own, folded])
    found = [np.zeros(0, np.int64)]
    for a, b in _meetings(key, n[row]):
        x, y = row[a], row[b]
        near = (x != y) & (17 * (1 + np.minimum(n[x] - place[a], n[y] - place[b])) >= 7 * (n[x] + n[y]))
        x, y = x[near], y[near]
        for level in np.unique(size[x]).tolist():
            of, sign = np.flatnonzero(size[x] == level), levels[level]
            for begin in range(0, len(of), max(1, SIGNS // level)):
                i, j = (side[of[begin : begin + max(1, SIGNS // level)]] for side in (x, y))
                s, t = sign[at[0, i]], sign[np.where(size[j] == level, at[0, j], at[1, j])]
                both = np.bitwise_count(s & t).sum(1, dtype=np.int64)
                common = np.minimum(n[i] - np.bitwise_count(s).sum(1, dtype=np.int64), n[j] - np.bitwise_count(t).sum(1, dtype=np.int64)) + both
                allowed = 17 * common >= 7 * (n[i] + n[j])
                found.append(np.unique(np.minimum(i, j)[allowed] * len(n) + np.maximum(i, j)[allowed]))
    pairs = np.unique(np.concatenate(found))
    x, y = class_[pairs // max(1, len(n))], class_[pairs % max(1, len(n))]
    return pa.table({"class_a": np.minimum(x, y), "class_b": np.maximum(x, y)})


def like_pairs(docs: DataFrame) -> DataFrame:
    """(a, b, jaccard): pairs of docs(id, space, source, text) of one space and different sources whose word sets have a Jaccard similarity of 0.7 or more.

    Equal sets of a space are one class, whose words are moved once. Classes meet at the rarer words of their sets, of which similar ones share one: each goes once
    to each bucket of words that holds some of them, with a signature that grows with the set. What is written of a meeting are pairs whose sizes, places and
    signatures allow the similarity, hardly more than those that have it; it is then taken from the sets themselves."""
    ship(docs.sparkSession)
    spark, path = docs.sparkSession, scratch.folder(docs.sparkSession, "like")
    kept = lambda rows, name: (rows.write.option("compression", "zstd").parquet(f"{path}/{name}"), spark.read.parquet(f"{path}/{name}"))[1]
    texts = docs.select(F.col("id").cast("long"), F.col("space").cast("string"), F.col("source").cast("string"), F.lower("text").alias("text"))
    rows = kept(texts.mapInArrow(_word_sets, "id long, space string, source string, words string, of binary").withColumn("number", F.monotonically_increasing_id()), "rows")
    classes = kept(rows.groupBy("of").agg(F.min("number").alias("class"), F.first("space").alias("space"), F.first("words").alias("words")), "classes")
    counts = classes.select(F.explode(F.split("words", " ")).alias("word")).groupBy("word").count().where("count > 1")
    common = kept(counts.orderBy(F.desc("count"), "word").limit(FREQUENT), "common")  # written, as each task's first ones would go to the driver otherwise
    place = {r.word: k for k, r in enumerate(common.orderBy("count", F.desc("word")).toLocalIterator())}
    total = classes.agg(F.sum(F.floor(3 * F.size(F.split("words", " ")) / 10) + 1)).first()[0] or 0
    prefixes = classes.select("class", "space", "words").mapInArrow(_prefixes(place, max(BUCKETS, total // BUCKET + 1)), "bucket int, class long, space long, n long, sign binary, held binary")
    met = kept(prefixes.groupBy("bucket").applyInArrow(_met, "class_a long, class_b long").distinct(), "met")
    wanted = met.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    sets = classes.select("class", "space", "words").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_CLASSES else wanted, "class", "left_semi")
    both = met.join(sets.toDF("class_a", "space_a", "words_a"), "class_a").join(sets.toDF("class_b", "space_b", "words_b"), "class_b").where("space_a = space_b")
    near = both.select("class_a", "class_b", "words_a", "words_b").mapInArrow(_shared, "class_a long, class_b long, common int, both int").where("17 * common >= 7 * both")
    near = near.select("class_a", "class_b", F.expr("round(cast(common as double) / (both - common), 4)").alias("jaccard"))
    near = near.union(classes.select("class", "class", F.lit(1.0)))
    members = rows.join(classes.select("of", "class"), "of").select("id", "source", "class")
    out = near.join(members.toDF("id_a", "source_a", "class_a"), "class_a").join(members.toDF("id_b", "source_b", "class_b"), "class_b")
    out = out.where(~F.col("source_a").eqNullSafe(F.col("source_b")) & (F.expr("id_a < id_b") | (F.expr("id_a > id_b and class_a <> class_b"))))
    return out.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "jaccard")
