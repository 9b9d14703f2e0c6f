"""Ranked lexical search by WAND over shards of documents.

Documents are read once: each task cuts what it reads into shards of a bounded number of documents and keeps, for terms that queries hold,
their postings (document, occurrences) in a table in the shared folder. Corpus statistics (documents, terms, documents of a term) are sums
over shards. Each query then walks each shard by WAND: terms stand at their next document, in order; the pivot is the first document
at which the terms' greatest impacts in the shard add up to what the heap asks for; documents before it are skipped by binary search, and it alone
is scored in full. What the heap asks for begins at a score that k documents of the corpus are known to reach: documents that hold
a query's weightiest terms are scored first, and the k-th best of all shards is handed to all. Shard heaps are merged per query.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. Scores are whole numbers (see `impacts`).

Queries go by blocks of at most TERMS distinct terms and QUERIES queries, which bounds what is broadcast; each block reads the documents again.
Memory of a task: one shard's postings and their walk, at most DOCUMENTS documents or POSTINGS postings and one document more.

Defined results: null or empty texts hold no term, are no hit and don't count; a null doc_id is a document as any other, last among equal
scores; repeated rows are documents each; each row of the queries is a query, also if its id is null or repeated; without documents or terms there are no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, scratch

TERMS, QUERIES = 100_000, 20_000
DOCUMENTS, POSTINGS = 8_192, 1_000_000
#: Documents of the weightiest terms that are scored ahead, of each query and shard.
AHEAD = 64
#: Bytes of a text whose terms are counted at a time.
SLICE = 1 << 22
_SPACES = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
_SHARD = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("docs", pa.binary()), ("tfs", pa.binary())])
_SHARD_KINDS = "n_docs long, n_terms long, terms array<int>, counts array<int>, ids array<bigint>, sizes array<bigint>, docs binary, tfs binary"


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded length."""
    raw = text.encode().translate(_SPACES)
    at = 0
    while len(raw) - at > SLICE:
        end = raw.find(b" ", at + SLICE)
        if end < 0:
            break
        yield raw[at:end].split()
        at = end
    yield raw[at:].split() if at else raw.split()


class _Shard:
    """Documents gathered until a shard is full."""

    def __init__(self):
        self.n_docs = self.n_terms = self.n_postings = 0
        self.ids, self.sizes, self.found = [], [], []

    def add(self, id_: int | None, size: int, tf: list[tuple[int, int]]) -> None:
        self.n_docs += 1
        self.n_terms += size
        if tf:
            self.ids.append(id_)
            self.sizes.append(size)
            self.found.append(np.array(tf, np.int32))
            self.n_postings += len(tf)

    def row(self) -> pa.RecordBatch:
        """Documents in order of their ids, postings in order of term and document."""
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        found = [self.found[k] for k in order]
        term, tf = np.concatenate(found).T if found else np.zeros((2, 0), np.int32)
        doc = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
        by = np.argsort(term, kind="stable")
        held, counts = np.unique(term, return_counts=True)
        values = [self.n_docs, self.n_terms, held.tolist(), counts.tolist(), [self.ids[k] for k in order], [self.sizes[k] for k in order], doc[by].astype("<i4").tobytes(), tf[by].astype("<i4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SHARD)], schema=_SHARD)


def _sharded(place: dict[bytes, int], documents: int, postings: int):
    def run(batches):
        held, wanted = _Shard(), place.__contains__
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                size, tf = 0, Counter()
                for found in terms(text.as_py() or ""):
                    size += len(found)
                    tf.update(filter(wanted, found))
                if size:
                    held.add(id_, size, [(place[t], n) for t, n in tf.items()])
                if held.n_docs >= documents or held.n_postings >= postings:
                    yield held.row()
                    held = _Shard()
        if held.n_docs:
            yield held.row()

    return run


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def impacts(tf: np.ndarray, size: np.ndarray, weight: int, n: int, total: int) -> np.ndarray:
    """What a term of a weight adds to the scores of documents with `size` terms that hold it tf times."""
    m = 75 + (25 * size * n) // total
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class _Lists:
    """A shard's postings as lists by term, made when a query asks for them."""

    def __init__(self, row: dict, weight: np.ndarray, n: int, total: int):
        self.docs, self.tfs = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["tfs"], "<i4").astype(np.int64)
        ends = np.cumsum(row["counts"])
        self.at = {t: (e - c, e) for t, c, e in zip(row["terms"], row["counts"], ends.tolist())}
        self.ids, self.sizes = row["ids"], np.array(row["sizes"], np.int64)
        self.weight, self.n, self.total, self.made = weight, n, total, {}

    def of(self, query: list[tuple[int, int]]) -> list[tuple[list[int], list[int], int, int]]:
        """(documents, impacts, greatest impact, repeats in the query) of each of a query's terms (term, repeats) that the shard holds."""
        out = []
        for term, times in query:
            if term in self.at and self.weight[term] > 0:
                if term not in self.made:
                    a, b = self.at[term]
                    docs = self.docs[a:b]
                    worth = impacts(self.tfs[a:b], self.sizes[docs], int(self.weight[term]), self.n, self.total)
                    self.made[term] = docs.tolist(), worth.tolist(), int(worth.max())
                out.append((*self.made[term], times))
        return out


def ahead(lists: list, k: int) -> list[int]:
    """Scores of up to AHEAD documents that hold the terms of the greatest impact, the best k."""
    chosen = set()
    for docs, _, _, _ in sorted(lists, key=lambda x: -x[2]):
        chosen.update(docs[: AHEAD - len(chosen)])
        if len(chosen) >= AHEAD:
            break
    scores = []
    for d in chosen:
        score = 0
        for docs, worth, _, times in lists:
            at = bisect_left(docs, d)
            if at < len(docs) and docs[at] == d:
                score += times * worth[at]
        scores.append(score)
    return heapq.nlargest(k, scores)


def wand(lists: list, k: int, least: int = 1) -> list[tuple[int, int]]:
    """(score, document) of the best k documents with a score of at least `least`; of equal scores the first documents. A heap holds
    the best so far; documents come in order, so one must beat the heap's least to enter."""
    heap, need = [], least
    most = [times * best for _, _, best, times in lists]
    docs, worth, times = [x[0] for x in lists], [x[1] for x in lists], [x[3] for x in lists]
    place, sizes = [0] * len(lists), list(map(len, docs))
    now = [d[0] for d in docs]
    live = list(range(len(lists)))
    while live:
        live.sort(key=now.__getitem__)
        bound = 0
        for j, i in enumerate(live):
            bound += most[i]
            if bound >= need:
                break
        else:
            break
        pivot = now[live[j]]
        if now[live[0]] == pivot:
            score, ended = 0, False
            for i in live:
                if now[i] != pivot:
                    break
                score += times[i] * worth[i][place[i]]
                place[i] += 1
                if place[i] < sizes[i]:
                    now[i] = docs[i][place[i]]
                else:
                    ended, now[i] = True, -1
            if score >= need:
                if len(heap) < k:
                    heapq.heappush(heap, (score, -pivot))
                else:
                    heapq.heapreplace(heap, (score, -pivot))
                if len(heap) == k:
                    need = max(least, heap[0][0] + 1)
        else:
            ended = False
            for i in live[:j]:
                if now[i] < pivot:
                    place[i] = bisect_left(docs[i], pivot, place[i])
                    if place[i] < sizes[i]:
                        now[i] = docs[i][place[i]]
                    else:
                        ended, now[i] = True, -1
        if ended:
            live = [i for i in live if now[i] >= 0]
    return [(score, -d) for score, d in heap]


def _walk(asked: list[list[tuple[int, int]]], weight: np.ndarray, n: int, total: int, k: int, least: list[int] | None):
    """Without `least` the scores known ahead, else the hits of the shards' heaps."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard, out = _Lists(row, weight, n, total), []
                for q, query in enumerate(asked):
                    lists = shard.of(query)
                    if lists and least is None:
                        out += [(q, s) for s in ahead(lists, k)]
                    elif lists:
                        out += [(q, shard.ids[d], s) for s, d in wand(lists, k, least[q])]
                kinds = (("query", pa.int32()), ("score", pa.int64())) if least is None else (("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=[name for name, _ in kinds])

    return run


def _first(rows: DataFrame, k: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def _block(docs: DataFrame, asked: list[tuple], k: int, documents: int, postings: int) -> DataFrame | None:
    """(query, doc_id, score, rank) of a block of queries, query being the place in `asked`."""
    place: dict[bytes, int] = {}
    numbered = [[(place.setdefault(t, len(place)), c) for t, c in Counter(found).items()] for _, found in asked]
    if not place:
        return None
    shards = scratch(map_arrow(docs, _sharded(place, documents, postings), _SHARD_KINDS), "shards")
    n, total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n:
        return None
    held = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df"))
    df = np.zeros(len(place), np.int64)
    for r in held.toLocalIterator():  # a row for each term of the block at most
        df[r.terms] = r.df
    weight = weights(df, n)
    known = map_arrow(shards, _walk(numbered, weight, n, total, k, None), "query int, score long")
    least = [1] * len(asked)
    for r in _first(known, k, F.desc("score")).where(F.col("rank") == k).toLocalIterator():  # a row for each query at most
        least[r.query] = max(1, r.score)
    hits = map_arrow(shards, _walk(numbered, weight, n, total, k, least), "query int, doc_id long, score long")
    return _first(hits, k, F.desc("score"), F.asc_nulls_last("doc_id"))


def search(docs: DataFrame, queries: DataFrame, k: int = 20, documents: int = DOCUMENTS, postings: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best rows of docs(doc_id, text) for each row of queries(item_id, text); of equal scores
    the least doc_id first."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = queries.select("item_id", F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    out, block, size = [], [], 0

    def searched() -> None:
        hits = _block(rows, block, k, documents, postings)
        if hits is not None:
            names = spark.createDataFrame([(q, id_) for q, (id_, _) in enumerate(block)], f"query int, item_id {kind}")
            out.append(hits.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))

    for item in items.toLocalIterator():
        found = [t for part in terms(item.text or "") for t in part]
        if block and (size + len(found) > TERMS or len(block) >= QUERIES):
            searched()
            block, size = [], 0
        block.append((item.item_id, found))
        size += len(found)
    if block:
        searched()
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    whole = out[0]
    for part in out[1:]:
        whole = whole.union(part)
    return whole
