"""Ranked search as functions on DataFrames: BM25 and cosine top-k, fusion, thresholds, rescue, caps, decay, and the whole search path.

Hits are (query, id, score, rank); rank counts from 1 by score, rounded to SCALE digits, and then by id. BM25 and cosine score
documents where they are read: queries are broadcast in blocks whose size is checked, each task keeps its own best k of every
query, and only those are exchanged, so what is shuffled is tasks x queries x k rows whatever the matches.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship

SCALE = 6
#: Candidates that take the memory which the arrays of one document's candidates take besides.
ARRAYS = 24
#: Query terms, or numbers of query vectors, that are broadcast at a time; more queries go by several passes.
TERMS_AT_A_TIME, NUMBERS_AT_A_TIME = 2_000_000, 8_000_000
_HITS = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
_HIT_KINDS = "query long, id long, score double"
_TOKEN = re.compile("[a-z0-9]+")

# Constants of BM25, fusion, thresholds, rescue, caps and decay.
K1, B = 1.2, 0.75
RRF_K, VECTOR_FIRST, VECTOR_LIFT, FUSED_MOST, BM25_ALONE = 20, 8, 0.5, 20, 0.3
THRESHOLD, LEAST_THRESHOLD, OF_TOP, DEVIATIONS, FEW, ALWAYS = 0.4, 0.25, 0.55, 1.5, 4, 3
RESCUE_SHARE, RESCUE_MOST, AGENT_SHARE, HALF_LIFE = 0.6, 3, 0.6, 30


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def ranked(hits: DataFrame, k: int | None = None) -> DataFrame:
    """hits(query, id, score, ...) with rank, the first k of each query."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", SCALE)), "id"))
    out = hits.drop("rank").withColumn("rank", place.cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


class Top:
    """The best k of each query among scores that come document by document: candidates that reach a query's present k-th score, thinned out when they are
    many. Memory: a few times queries x k rows and one score for each query, whatever the documents."""

    def __init__(self, queries: np.ndarray, k: int, room: int = 1 << 18):
        self.queries, self.k, self.room = queries, k, max(room, 2 * k * len(queries))
        self.least, self.held, self.size = np.full(len(queries), -np.inf), [], 0

    def add(self, id_: int, scores: np.ndarray, hit: np.ndarray, *more: np.ndarray) -> None:
        """A document's scores of all queries; `more` are values that are handed on."""
        at = np.flatnonzero(hit & (scores >= self.least))
        if len(at):
            self.held.append((at, np.full(len(at), id_), scores[at], *(m[at] for m in more)))
            self.size += len(at) + ARRAYS  # many documents with few candidates each hold more in arrays than in candidates
            if self.size > self.room:
                self._thin()

    def extend(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, hit: np.ndarray) -> None:
        """scores and hit are (query, document), of some queries by their numbers."""
        q, d = np.nonzero(hit & (scores >= self.least[queries][:, None]))
        self.held.append((queries[q], ids[d], scores[q, d]))
        self.size += len(q)
        if self.size > self.room:
            self._thin()

    def _thin(self) -> tuple:
        columns = [np.concatenate(c) for c in zip(*self.held)] if self.held else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        order = np.lexsort((columns[1], -np.round(columns[2], SCALE), columns[0]))
        query = columns[0][order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[place < self.k]
        columns = [c[order] for c in columns]
        full = place[place < self.k] == self.k - 1
        self.least[columns[0][full]] = columns[2][full] - 10.0**-SCALE  # scores are compared as rounded
        self.held, self.size = [tuple(columns)], len(order)
        return columns

    def columns(self) -> list[np.ndarray]:
        """query, id, score and what was handed on, of the best."""
        query, *rest = self._thin()
        return [self.queries[query], *rest]


class _Best:
    """The best k of each query among blocks of scores."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.ids, self.scores = np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0))

    def add(self, ids: np.ndarray, scores: np.ndarray, seen: np.ndarray) -> None:
        """scores and seen are (query, document); what is not seen is no hit."""
        scores = np.concatenate([self.scores, np.where(seen, scores, -np.inf)], 1)
        ids = np.concatenate([self.ids, np.broadcast_to(ids, (len(self.queries), len(ids)))], 1)
        order = np.lexsort((ids, -np.round(scores, SCALE)), axis=1)[:, : self.k]
        self.ids, self.scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def batch(self) -> pa.RecordBatch:
        held = np.isfinite(self.scores)
        query = np.broadcast_to(self.queries[:, None], held.shape)
        return pa.RecordBatch.from_arrays([pa.array(query[held]), pa.array(self.ids[held]), pa.array(self.scores[held])], schema=_HITS)


def _blocks(rows: list, weight, most: int):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = parts[0] if parts else empty
    for part in parts[1:]:
        out = out.union(part)
    return out


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores where they come in fewer parts, as a small table in one file does; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() < cores else rows


class Asked:
    """Queries by the terms that they hold: for each term the queries, laid end to end."""

    def __init__(self, terms_of: list[list[int]], n_terms: int):
        pairs = np.array([(t, q) for q, terms in enumerate(terms_of) for t in terms], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.of, self.starts, self.n = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(n_terms + 1)), len(terms_of)

    def sums(self, terms: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """For each query the sum of what its terms are worth."""
        size = self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(self.starts[terms] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.of[at], np.repeat(worth, size), self.n)


def bm25_worth(idf: np.ndarray, tf: np.ndarray, length: float, mean: float, k1: float, b: float) -> np.ndarray:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _counts(terms: dict[str, int]):
    """How many texts hold each term; at -1 the texts with a token, at -2 their tokens."""

    def run(batches):
        df, n, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0):
                found = _TOKEN.findall((text.as_py() or "").lower())
                n, total = n + bool(found), total + len(found)
                df[[terms[t] for t in terms.keys() & found]] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[held, -1, -2]), pa.array(np.r_[df[held], n, total])], names=["term", "n"])

    return run


def _looked_up(terms: dict[str, int]):
    """How many rows (id, text) with an id hold each term, and the least id; rows whose id is null count as none."""

    def run(batches):
        n, first, seen = np.zeros(len(terms), np.int64), np.full(len(terms), 2**63 - 1), np.zeros(len(terms), bool)
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = [terms[t] for t in terms.keys() & set(_TOKEN.findall((text.as_py() or "").lower()))]
                seen[at] = True
                if id_ is not None:
                    n[at] += 1
                    first[at] = np.minimum(first[at], id_)
        held = np.flatnonzero(seen)
        words = list(terms)
        yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in held], pa.string()), pa.array(n[held]), pa.array(first[held], mask=n[held] == 0)], names=["term", "n", "first"])

    return run


def token_lookup(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, term, first, docs): for each token of queries(query, text) that docs(id, text) hold, the least id and how many ids hold it (J23). Terms are counted where
    texts are read, a row for each task and term; rows of one id are put together before, if there are any."""
    ship(docs.sparkSession)
    spark, docs = docs.sparkSession, docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    often = docs.where("id is not null").groupBy("id").count().where("count > 1").select("id")
    if not often.isEmpty():
        one = docs.join(often, "id", "left_semi").groupBy("id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
        docs = docs.join(often, "id", "left_anti").unionByName(one)
    asked = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    wanted = (r.term for r in asked.select("term").distinct().toLocalIterator())
    parts = [spread(docs).mapInArrow(_looked_up({t: k for k, t in enumerate(block)}), "term string, n long, first long") for block in _blocks(wanted, lambda _: 1, TERMS_AT_A_TIME)]
    found = _union(parts, spark.createDataFrame([], "term string, n long, first long")).groupBy("term").agg(F.min("first").alias("first"), F.sum("n").alias("docs"))
    return asked.join(found, "term").select("query", "term", "first", "docs")


def _bm25(terms: dict[str, int], asked: Asked, idf: np.ndarray, queries: np.ndarray, mean: float, k: int, k1: float, b: float):
    def run(batches):
        top = Top(queries, k)
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = _TOKEN.findall((text.as_py() or "").lower())
                hit = sorted((terms[t], n) for t, n in Counter(filter(terms.__contains__, found)).items())
                if hit:
                    term, tf = np.array(hit).T
                    scores = asked.sums(term, bm25_worth(idf[term], tf, len(found), mean, k1, b))
                    top.add(id_, scores, scores > 0)
        query, ids, scores = top.columns()
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids, pa.int64()), pa.array(scores)], schema=_HITS)

    return run


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """Hits of docs(id, text) for each of queries(query, text), searched by any of their distinct tokens (R2, R3, W14). Texts are read twice for each block of
    queries: for the counts of their terms and for the scores."""
    ship(docs.sparkSession)
    spark, docs = docs.sparkSession, spread(docs.where("id is not null").select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")))
    asked = queries.select(F.col("query").cast("long").alias("query"), F.array_distinct(tokens(F.col("text"))).alias("terms"))
    parts = []
    for block in _blocks(asked.toLocalIterator(), lambda r: len(r.terms), TERMS_AT_A_TIME):
        place = {t: i for i, t in enumerate(sorted({t for r in block for t in r.terms}))}
        counts = docs.select("text").mapInArrow(_counts(place), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counts = {r.term: r.n for r in counts.toLocalIterator()}  # a row for each term of the block
        n, df = counts.get(-1, 0), np.array([counts.get(i, 0) for i in range(len(place))])
        if n and place:
            idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
            numbered = Asked([[place[t] for t in r.terms] for r in block], len(place))
            parts.append(docs.mapInArrow(_bm25(place, numbered, idf, np.array([r.query for r in block], np.int64), counts[-2] / n, k, k1, b), _HIT_KINDS))
    return ranked(_union(parts, spark.createDataFrame([], _HIT_KINDS)), k)


def _cosine(matrix: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int):
    def run(batches):
        best = _Best(queries, k)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, column = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                x = np.asarray(column.flatten(), np.float64).reshape(len(ids), -1)
                length = np.sqrt((x * x).sum(1))
                scores = (matrix @ x.T) / np.where(length > 0, length, np.inf)
                best.add(ids, scores, (own[:, None] != ids) & (length > 0))
        yield best.batch()

    return run


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Hits of vectors(id, vector) for each of queries(query, vector, own: an id that is no hit, or null), all compared.
    Vectors have one length; a null or zero vector is no hit."""
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vector").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = queries.where(F.col("vector").isNotNull()).select(F.col("query").cast("long"), F.col("vector").cast("array<double>"), F.coalesce(F.col("own").cast("long"), F.lit(-(2**63))).alias("own"))
    parts = []
    for block in _blocks(asked.toLocalIterator(), lambda r: len(r.vector), NUMBERS_AT_A_TIME):
        matrix = np.array([r.vector for r in block])
        length = np.sqrt((matrix * matrix).sum(1, keepdims=True))
        matrix = matrix / np.where(length > 0, length, np.inf)
        parts.append(spread(rows).mapInArrow(_cosine(matrix, np.array([r.query for r in block], np.int64), np.array([r.own for r in block], np.int64), k), _HIT_KINDS))
    return ranked(_union(parts, spark.createDataFrame([], _HIT_KINDS)), k)


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(query, id, score, lists): reciprocal ranks of an id in every list, summed."""
    every = lists[0].select("query", "id", "rank")
    for hits in lists[1:]:
        every = every.union(hits.select("query", "id", "rank"))
    return every.groupBy("query", "id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.count("*").alias("lists"))


def fuse(vector: DataFrame, lexical: DataFrame, most: int = FUSED_MOST) -> DataFrame:
    """Vector and lexical hits as one list (R8): the leading vector hits keep their cosine and a lift. Queries with one kind of hits
    only have those: vectors as they are, lexical scores weighted."""
    both = rrf([vector, lexical]).join(vector.select("query", "id", F.col("score").alias("cosine"), F.col("rank").alias("of_vector")), ["query", "id"], "left")
    both = both.join(lexical.select("query", "id", F.col("score").alias("bm25")), ["query", "id"], "left")
    kinds = both.groupBy("query").agg(F.count("cosine").alias("n_vector"), F.count("bm25").alias("n_lexical"))
    lifted = F.when(F.col("of_vector") <= VECTOR_FIRST, F.greatest("score", F.col("cosine") + VECTOR_LIFT)).otherwise(F.col("score"))
    score = F.when(F.col("n_lexical") == 0, F.col("cosine")).when(F.col("n_vector") == 0, F.col("bm25") * BM25_ALONE).otherwise(lifted)
    return ranked(both.join(kinds, "query").select("query", "id", score.alias("score"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.coalesce("bm25", F.lit(0.0)).alias("bm25")), most)


def dynamic_threshold(hits: DataFrame, static: float = THRESHOLD) -> DataFrame:
    """(query, threshold) from each query's scores (P10)."""
    s = hits.groupBy("query").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.median("score").alias("middle"), F.stddev_samp("score").alias("spread"))
    low = F.when(F.col("spread") == 0, F.col("middle") * 0.5).otherwise(F.col("middle") - DEVIATIONS * F.col("spread"))
    many = F.least(F.lit(static), F.greatest(F.lit(LEAST_THRESHOLD), F.col("top") * OF_TOP, low))
    return s.select("query", F.when(F.col("n") < FEW, F.least(F.lit(static), F.col("top") * OF_TOP)).otherwise(many).alias("threshold"))


def merge_keep_top(hits: DataFrame, more: DataFrame, keep: int = 0, floor: Column | None = None) -> DataFrame:
    """hits and those of more(query, id, score) that are not among them, by score, but the first `keep` hits stay first."""
    new = more.join(hits.select("query", "id"), ["query", "id"], "left_anti").dropDuplicates(["query", "id"])
    new = new.select("query", "id", (F.greatest("score", floor) if floor is not None else F.col("score")).alias("score"), F.lit(True).alias("added"))
    old = hits.select("query", "id", "score", (F.col("rank") > keep).alias("added"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("added", F.desc(F.round("score", SCALE)), "id"))
    return old.union(new).withColumn("rank", place.cast("long")).drop("added")


def rescue(hits: DataFrame, lexical: DataFrame, share: float = RESCUE_SHARE, most: int = RESCUE_MOST) -> DataFrame:
    """Lexical hits of at least a share of their query's best score that are not among hits, the first `most`."""
    top = lexical.groupBy("query").agg(F.max("score").alias("top"))
    good = lexical.join(top, "query").where(F.col("score") >= share * F.col("top")).join(hits.select("query", "id"), ["query", "id"], "left_anti")
    return ranked(good.select("query", "id", "score"), most)


def agent_cap(hits: DataFrame, share: float = AGENT_SHARE) -> DataFrame:
    """hits(query, id, rank, agent) with place: those beyond an agent's share of a query's hits go to the end, in order."""
    of_agent = F.row_number().over(Window.partitionBy("query", "agent").orderBy("rank"))
    cap = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("query")) * share))
    over = hits.withColumn("over", (of_agent > cap).cast("int"))
    return over.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("over", "rank")).cast("long")).drop("over")


def decay(score: Column, age_days: Column, half_life: float = HALF_LIFE) -> Column:
    """A score halved with each half-life of its age (D3); without an age it stays."""
    return F.when(age_days.isNull(), score).otherwise(score * F.exp(-F.log(F.lit(2.0)) * F.greatest(F.lit(0), age_days) / half_life))


def search(
    docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 20, coarse: int = 64, half_life: float = HALF_LIFE, static: float = THRESHOLD
) -> DataFrame:
    """The search path (R12, R20): vector and lexical hits fused, scores decayed by age and moved by importance, cut at the dynamic threshold
    but for the first ALWAYS, rescued by lexical hits, capped by agent, the first k.

    docs(id, text, agent, age_days, importance), vectors(id, vector), queries(query, text, vector, own). Gives (query, id, score, place, rescued).
    """
    # rankings of queries x coarse rows, which several steps read
    lexical = bm25_topk(docs, queries, coarse).persist()
    vector = cosine_topk(vectors.join(docs.select("id"), "id", "left_semi"), queries, coarse)
    fused = fuse(vector, lexical, coarse)
    about = docs.select("id", "agent", "age_days", "importance")
    scored = fused.join(about, "id").withColumn("score", decay(F.col("score"), F.col("age_days"), half_life) * (1 + 0.3 * (F.coalesce("importance", F.lit(0.5)) - 0.5)))
    scored = ranked(scored.select("query", "id", "score")).persist()
    limits = dynamic_threshold(scored, static)
    kept = scored.join(limits, "query").where((F.col("score") >= F.col("threshold")) | (F.col("rank") <= ALWAYS)).persist()
    saved = rescue(kept, lexical).join(limits, "query").select("query", "id", F.col("threshold").alias("score"), F.lit(True).alias("rescued")).persist()
    merged = merge_keep_top(kept.select("query", "id", "score", "rank"), saved.select("query", "id", "score"))
    out = merged.join(saved.select("query", "id", "rescued"), ["query", "id"], "left").join(about.select("id", "agent"), "id")
    return agent_cap(out).where(F.col("place") <= k).select("query", "id", "score", "place", F.coalesce("rescued", F.lit(False)).alias("rescued"))
