"""Full-text search on a positional inverted index: postings kept as tables that change by deltas, stemmed and exact, any, all and phrase.

Two tables stand under one log of commits (`sources.commits`). postings: a row for each term and block of chunks, with the chunks' ids and
places, the rows of a block in the order of their stems, so a search for a few words reads few pages of each; blocks are made where chunks are read, without
an exchange or a sort of more than a block, so a frequent term is as many rows as there are blocks. chunks: a row for each change of a chunk with its length and
attributes; `posted` is the commit whose postings are the chunk's, so that older ones are not read. Stemmed search takes all terms
with the stem of a query's token, exact search the token itself among them.

A query is a list of parts; a part is one token or several that follow each other. In mode "any" one part must be found, in "all" every part, and a "phrase" is
one part. Chunks rank by BM25 over parts (or by the density of covers), lifted by their importance.

What a search moves: counts of the query terms, and places where parts have several tokens, packed and once, to their chunks. No step holds a term's postings in one
task, and parts are met in chunks, so what is moved doesn't grow with the parts that hold a term.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import stemming, text
from ..ship import ship
from ..sources.commits import Commits, latest
from . import ranking

# How importance lifts a score, and the scale of cover densities and weight of a word in them.
LIFT, IMPORTANCE = 0.3, 0.5
DENSITY_SCALE, WORD_WEIGHT = 32, 0.1
#: Hits from which the stricter modes run as well, and the constant of their fusion.
MANY, DUAL_K = 200, 20
#: Distinct tokens of queries up to which they are broadcast to the postings; and whose stems are sent down to the scan.
BROADCAST_TOKENS, PUSHED_TOKENS = 100_000, 2_000
#: Replaced or deleted chunks up to which they are broadcast.
BROADCAST_DEAD = 1_000_000
#: Bytes of text in a block of chunks, about a million tokens, and chunks of one at most.
BYTES, BLOCK = 6_000_000, 4_096
_HIT = "query long, id long, score double, plain double"
_POSTING = pa.schema([("stem", pa.string()), ("term", pa.string()), ("ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("positions", pa.list_(pa.list_(pa.int32())))])


#: Whether a byte of lower-cased UTF-8 is part of a token.
_OF_TOKEN = np.zeros(256, bool)
_OF_TOKEN[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of lower-cased texts, which of them are of tokens, where each token begins, and how many each text has."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    held = _OF_TOKEN[data]
    begins = np.flatnonzero(held & ~np.r_[False, held[:-1]])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return data, held, begins, np.diff(np.searchsorted(begins, ends), prepend=0)


def _block(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
    """A row for each term of a block of chunks, by their stems: the chunks' ids, how often each holds it, and where."""
    data, held, begins, sizes = _tokens(texts)
    offsets = np.r_[0, np.cumsum(np.flatnonzero(held[:-1] & ~held[1:]) + 1 - begins)].astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[held])]).dictionary_encode()
    words = flat.dictionary.cast(pa.string())
    stems = pa.array(map(stemming.stem, words.to_pylist()), pa.string())
    by = pc.sort_indices(pa.table([stems, words], names=["stem", "term"]), [("stem", "ascending"), ("term", "ascending")])
    rank = np.empty(len(by), np.int32)
    rank[by.to_numpy()] = np.arange(len(by))
    term = rank[flat.indices.to_numpy()]
    chunk, place = np.repeat(np.arange(len(ids)), sizes), np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(term, kind="stable")
    term, chunk, place = term[order], chunk[order], place[order].astype(np.int32)
    begins = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (chunk[1:] != chunk[:-1])][: len(term)])
    terms = np.searchsorted(term[begins], np.arange(len(words)))
    ends = np.r_[begins, len(term)].astype(np.int32)
    places, tfs = pa.ListArray.from_arrays(pa.array(ends), pa.array(place)), pa.array(np.diff(ends))
    outer = pa.array(np.r_[terms, len(begins)].astype(np.int32))
    found = pa.array(np.array(ids, np.int64)[chunk[begins]])
    return pa.RecordBatch.from_arrays([stems.take(by), words.take(by), pa.ListArray.from_arrays(outer, found), pa.ListArray.from_arrays(outer, tfs), pa.ListArray.from_arrays(outer, places)], schema=_POSTING)


def _posted(batches):
    ids, texts, size = [], [], 0
    for batch in batches:
        for id_, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(id_)
            texts.append((value.as_py() or "").lower().encode())
            size += len(texts[-1])
            if size >= BYTES or len(ids) >= BLOCK:
                yield _block(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield _block(ids, texts)


def _lengths(texts: pa.Array) -> pa.Array:
    found = [_tokens([(t.as_py() or "").lower().encode() for t in texts[at : at + BLOCK]])[3] for at in range(0, len(texts), BLOCK)]
    return pa.array(np.concatenate([np.zeros(0), *found]).astype(np.int32))


def length(text: Column) -> Column:
    """The number of a text's tokens."""
    ship(SparkSession.active())
    return F.arrow_udf(_lengths, "int")(text.cast("string"))


def postings(chunks: DataFrame) -> DataFrame:
    """(stem, term, ids, tfs, positions) of chunks(id, text), made where they are read, sorted by stem within a block."""
    ship(chunks.sparkSession)
    texts = chunks.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_posted, "stem string, term string, ids array<bigint>, tfs array<int>, positions array<array<int>>")


class Index:
    """The tables of an index at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.commits = spark, Commits(spark, path)

    def _live(self, version: int | None = None) -> DataFrame | None:
        rows = self.commits.read("chunks", version)
        return None if rows is None else latest(rows, "id")

    def upsert(self, chunks: DataFrame) -> int:
        """chunks(id, text, ...) take the place of those with their ids; other columns are attributes that searches can filter by (M17). Rows with a
        null id are left out; of several with one id, any one is taken; texts are only exchanged for ids that stand several times."""
        chunks = chunks.where("id is not null").withColumn("id", F.col("id").cast("long"))
        often = chunks.groupBy("id").count().where("count > 1").select("id")
        if not often.isEmpty():
            chunks = chunks.join(often, "id", "left_anti").unionByName(chunks.join(often, "id", "left_semi").dropDuplicates(["id"]))

        def make(base: int):
            number = base + 1
            attributes = [c for c in chunks.columns if c not in ("id", "text")]
            rows = chunks.select("id", length(F.col("text")).alias("length"), F.lit(number).cast("long").alias("posted"), F.lit(False).alias("gone"), F.lit(False).alias("excluded"), *attributes)
            return {"chunks": rows, "postings": postings(chunks)}, {}

        return self.commits.change(make)

    def _marked(self, ids: DataFrame, **marks: Column) -> int:
        def make(base: int):
            held = self._live(base).join(ids.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
            return {"chunks": held.withColumns(marks).drop("seq")}, {}

        return self.commits.change(make)

    def delete(self, ids: DataFrame) -> int:
        return self._marked(ids, gone=F.lit(True))

    def exclude(self, ids: DataFrame, excluded: bool = True) -> int:
        """Chunks that count in the statistics and are no hits, or are hits again."""
        return self._marked(ids, excluded=F.lit(excluded))

    def compact(self) -> int:
        """All tables anew, without what later commits have replaced."""
        base = self.commits.version()
        live = self._live(base)
        one = _each(self.commits.read("postings", base)).join(live.select("id", F.col("posted").alias("seq")), ["id", "seq"], "left_semi")
        block = F.pmod(F.hash("id"), F.lit(1 + live.count() // BLOCK))
        both = one.groupBy("stem", "term", "seq", block).agg(F.array_sort(F.collect_list(F.struct("id", "positions"))).alias("b"))
        held = both.select("stem", "term", F.col("b.id").alias("ids"), F.transform("b.positions", F.size).alias("tfs"), F.col("b.positions").alias("positions"), "seq").sortWithinPartitions("stem", "term")
        tables = {"chunks": live, "postings": held}
        names = {t: self.commits.read(t, base).columns for t in tables}
        return self.commits.commit(base, {t: rows.select(*names[t]) for t, rows in tables.items()}, whole=tuple(tables))

    def vocabulary(self, version: int | None = None) -> DataFrame:
        """(term, stem, chunks, places) of all terms of live chunks."""
        every = self.commits.read("chunks", version).where("posted = seq and not gone").select("id", "seq")
        dead = every.join(self._live(version).select("id", F.col("posted").alias("seq")), ["id", "seq"], "left_anti")  # replaced or deleted since
        dead = F.broadcast(dead) if dead.count() <= BROADCAST_DEAD else dead
        one = _each(self.commits.read("postings", version), "tfs").join(dead, ["id", "seq"], "left_anti")
        return one.groupBy("term", "stem").agg(F.count("*").alias("chunks"), F.sum("tfs").alias("places"))

    def _matched(self, tokens: DataFrame, exact: bool, version: int) -> DataFrame:
        """Rows of postings with the terms of tokens(token, ...), and its columns."""
        terms = tokens.withColumn("stem", stemming.stemmed(F.col("token"))).persist()  # small: the queries' words
        n, held = terms.count(), self.commits.read("postings", version)
        if n <= PUSHED_TOKENS:
            held = held.where(F.col("stem").isin([r.stem for r in terms.select("stem").distinct().collect()]))
        found = held.join(F.broadcast(terms) if n <= BROADCAST_TOKENS else terms, "stem")
        return found.where(F.col("token") == F.col("term")) if exact else found

    def _gather(self, tokens: DataFrame, what: str, exact: bool, version: int) -> DataFrame:
        """(id, seq, what) of chunks, live or not, that hold tokens(number, token): a token's number with its counts ("tfs") or places ("positions"), packed."""
        ship(self.spark)
        found = self._matched(tokens, exact, version).select("number", "seq", "ids", what)
        return found.mapInArrow(_gathered(what == "positions"), f"id long, seq long, {what} binary")

    def _placed(self, parts: list[list[str]], exact: bool, version: int) -> tuple[DataFrame, _Phrases]:
        """(id, seq, positions) of the tokens of parts, and what finds the parts among them. A part with a token that no chunk holds asks for nothing."""
        every = {t: k for k, t in enumerate(dict.fromkeys(chain.from_iterable(parts)))}
        tokens = self.spark.createDataFrame([(k, t) for t, k in every.items()], "number int, token string")
        held = {r.number: r.n for r in self._matched(tokens, exact, version).groupBy("number").agg(F.sum(F.size("ids")).alias("n")).toLocalIterator()}  # a row for each token of the block
        whole = {k: [every[t] for t in p] for k, p in enumerate(parts) if all(every[t] in held for t in p)}
        wanted = set(chain.from_iterable(whole.values()))
        tokens = self.spark.createDataFrame([(k, t) for t, k in every.items() if k in wanted], "number int, token string")
        return self._gather(tokens, "positions", exact, version), _Phrases(whole, held)

    def _counted(self, parts: list[list[str]], exact: bool, version: int, live: DataFrame) -> DataFrame:
        """(id, length, lift, shown, held) of live chunks that hold parts: held has the parts' numbers and counts there, packed; a part may
        stand several times. Nothing else is moved, but for places where a part has several tokens."""
        numbered, several = list(enumerate(parts)), [k for k, p in enumerate(parts) if len(p) > 1]
        single = self.spark.createDataFrame([(k, p[0]) for k, p in numbered if len(p) == 1], "number int, token string")
        found, held = self._gather(single, "tfs", exact, version), F.collect_list("tfs").alias("held")
        if not several:
            return _live_ones(found.groupBy("id", "seq").agg(held), live).select("id", "length", "lift", "shown", "held")
        placed, phrases = self._placed([parts[k] for k in several], exact, version)
        both = found.withColumn("positions", F.lit(None).cast("binary")).unionByName(placed.withColumn("tfs", F.lit(None).cast("binary")))
        both = _live_ones(both.groupBy("id", "seq").agg(held, F.collect_list("positions").alias("positions")), live)
        return both.select("id", "length", "lift", "shown", "held", "positions").mapInArrow(_phrased(phrases, np.array(several)), _COUNTED)

    def _shown(self, version: int, where: Column | None) -> tuple[DataFrame, int, float]:
        """Live chunks (id, seq, length, shown, lift), how many have a token, and their mean length."""
        live = self._live(version)
        shown = ~F.col("excluded") if where is None else ~F.col("excluded") & F.coalesce(where, F.lit(False))
        lift = 1 + LIFT * F.coalesce(F.col("importance"), F.lit(IMPORTANCE)) if "importance" in live.columns else F.lit(1 + LIFT * IMPORTANCE)
        live = live.select("id", F.col("posted").alias("seq"), "length", shown.alias("shown"), lift.cast("double").alias("lift"))
        n, total = live.where("length > 0").agg(F.count("*"), F.sum("length")).first()
        return live, n, total / n if n else 0.0

    def _blocks(self, queries: DataFrame, *modes: str):
        """Blocks of queries(query, text): their ids, for each mode the numbers of each query's parts, and the parts; those of the first mode hold all others'."""
        asked = queries.where("query is not null").select(F.col("query").cast("long").alias("query"), *[F.array_distinct(parts_of(F.col("text"), mode)).alias(f"parts{k}") for k, mode in enumerate(modes)])
        for block in ranking._blocks(asked.toLocalIterator(), lambda r: sum(map(len, r.parts0)), ranking.TERMS_AT_A_TIME):
            place: dict[tuple, int] = {}
            numbers = [[[place.setdefault(tuple(p), len(place)) for p in r[1 + k]] for r in block] for k in range(len(modes))]
            if place:
                yield np.array([r.query for r in block], np.int64), numbers, [list(p) for p in place]

    def _matches(self, parts: list[list[str]], exact: bool, version: int, live: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
        """Shown chunks that hold parts, with their counts, and what a part weighs by how many live chunks hold it."""
        path = scratch.folder(self.spark, "matched")
        self._counted(parts, exact, version, live).write.option("compression", "zstd").parquet(path)
        matched, df = self.spark.read.parquet(path), np.zeros(len(parts))
        for r in matched.select("held").mapInArrow(_dfs(len(parts)), "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).toLocalIterator():  # a row for each part of the block
            df[r.part] = r.n
        return matched.where("shown").select("id", "length", "lift", "held"), np.log(1 + (n - df + 0.5) / (df + 0.5))

    def _best(self, hits: list[DataFrame], k: int) -> DataFrame:
        return ranking.ranked(ranking._union(hits, self.spark.createDataFrame([], _HIT)), k).select("query", "id", F.col("plain").alias("score"), "rank")

    def search(self, queries: DataFrame, k: int, mode: str = "any", exact: bool = False, where: Column | None = None, by: str = "bm25", version: int | None = None, k1: float = ranking.K1, b: float = ranking.B) -> DataFrame:
        """(query, id, score, rank) of queries(query, text), the first k of each by lifted score (R3, R4, J6, W14). `where` is a condition on the chunks'
        attributes; `by` is "bm25" or "density". Queries with a null id are left out."""
        version = self.commits.version() if version is None else version
        live, n, mean = self._shown(version, where)
        out = []
        for ids, (numbers,), parts in self._blocks(queries, mode) if n else ():
            if by == "density":
                placed, phrases = self._placed(parts, exact, version)
                held = _live_ones(placed.groupBy("id", "seq").agg(F.collect_list("positions").alias("positions")), live.where("shown"))
                out.append(held.select("id", "lift", "positions").mapInArrow(_dense(phrases, numbers, list(map(len, parts)), ids, k, mode), _HIT))
            else:
                matched, idf = self._matches(parts, exact, version, live, n)
                out.append(matched.mapInArrow(_scored(numbers, idf, ids, mean, k, mode == "all", k1, b), _HIT))
        return self._best(out, k)

    def dual(self, queries: DataFrame, k: int, where: Column | None = None, many: int = MANY) -> DataFrame:
        """(query, id, score, rank): any part; and where `many` chunks or more hold one, all parts and the phrase; and, for queries that hold an exact token,
        exact search; the first k of each fused by reciprocal ranks (R2, R5). The counts of any part are read for all parts as well, which are among them."""
        version = self.commits.version()
        live, n, mean = self._shown(version, where)
        most, loose, strict = max(k, many), [], []
        for ids, (numbers, all_of), parts in self._blocks(queries, "any", "all") if n else ():
            matched, idf = self._matches(parts, False, version, live, n)
            loose.append(matched.mapInArrow(_scored(numbers, idf, ids, mean, most, False, ranking.K1, ranking.B), _HIT))
            strict.append(matched.mapInArrow(_scored(all_of, idf, ids, mean, k, True, ranking.K1, ranking.B), _HIT))
        found = self._best(loose, most).persist()  # `most` rows of a query at most, so that those with `many` hits are known
        full = found.where(F.col("rank") == many).select("query")
        rich, sharp = queries.join(full, "query", "left_semi"), queries.where(text.asks_exactly(F.col("text")))
        lists = [found.where(F.col("rank") <= k), self._best(strict, k).join(full, "query", "left_semi"), self.search(rich, k, "phrase", where=where, version=version), self.search(sharp, k, "any", exact=True, where=where, version=version)]
        return ranking.ranked(ranking.rrf(lists, DUAL_K).select("query", "id", "score"), k)


def _live_ones(found: DataFrame, live: DataFrame) -> DataFrame:
    return found.join(live, ["id", "seq"])


def _hits_batch(top: ranking.Top) -> pa.RecordBatch:
    columns = top.columns()
    plain = columns[3] if len(columns) > 3 else np.zeros(0)
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(plain)], names=["query", "id", "score", "plain"])


def _scored(numbers: list[list[int]], idf: np.ndarray, queries: np.ndarray, mean: float, k: int, whole: bool, k1: float, b: float):
    """Scores of matched chunks for all queries, the best k of each; with `whole` only of queries whose every part is there."""
    asked, wanted = ranking.Asked(numbers, len(idf)), np.array(list(map(len, numbers)))

    def run(batches):
        top = ranking.Top(queries, k)
        for batch in _sliced(batches):
            columns = [batch.column(c).to_pylist() for c in range(3)]
            bounds, parts, tfs = _unpacked(batch.column(3))
            for id_, length, lift, begin, end in zip(*columns, bounds[:-1].tolist(), bounds[1:].tolist()):
                part, at = np.unique(parts[begin:end], return_inverse=True)
                tf = np.bincount(at, tfs[begin:end])
                plain = asked.sums(part, ranking.bm25_worth(idf[part], tf, length, mean, k1, b))
                hit = asked.sums(part, np.ones(len(part))) == wanted if whole else plain > 0
                top.add(id_, plain * lift, hit & (wanted > 0), plain)
        yield _hits_batch(top)

    return run


def _dfs(n_parts: int):
    """How many chunks hold each part."""

    def run(batches):
        df = np.zeros(n_parts, np.int64)
        for batch in _sliced(batches):
            bounds, parts, _ = _unpacked(batch.column(0))
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            df += np.bincount(np.unique(row * n_parts + parts) % n_parts, minlength=n_parts)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], names=["part", "n"])

    return run


#: Counts or places that a task gathers by chunk before it hands them on, chunks that are unpacked at a time, and those that are held against phrases together.
GATHERED, AT_A_TIME, TOGETHER = 1_000_000, 512, 2_048
_COUNTED = "id long, length int, lift double, shown boolean, held array<binary>"


def _sliced(batches, rows: int = AT_A_TIME):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _packed(number: np.ndarray, value: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Lists of (number, value), each list ascending by number, as steps of numbers and values of seven bits a byte."""
    each = np.zeros(2 * len(number), np.int64)
    each[0::2], each[1::2] = np.diff(number, prepend=0), value
    each[2 * begins] = number[begins]
    size = np.ones(len(each), np.int64)
    for bits in range(7, 63, 7):
        size += each >> bits > 0
    ends = np.r_[0, np.cumsum(size)]
    out = np.zeros(ends[-1], np.uint8)
    for k in range(size.max(initial=0)):
        at = np.flatnonzero(size > k)
        out[ends[at] + k] = (each[at] >> (7 * k) & 127) | np.where(size[at] > k + 1, 128, 0)
    offsets = ends[np.r_[2 * begins, len(each)]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _unpacked(held: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's pairs begin, one bound more than rows, and the numbers and values of all."""
    lists = np.r_[0, np.cumsum(pc.list_value_length(held).to_numpy())]
    flat = held.flatten()
    sizes = np.r_[0, np.cumsum(pc.binary_length(flat).to_numpy())].astype(np.int64)
    data = np.frombuffer(b"".join(flat.to_pylist()), np.uint8)
    ends = np.flatnonzero(data < 128)
    begins = np.r_[0, ends + 1][:-1]
    each = np.zeros(len(ends), np.int64)
    for k in range(int((ends - begins).max(initial=-1)) + 1):
        at = np.flatnonzero(ends - begins >= k)
        each[at] |= (data[begins[at] + k] & 127).astype(np.int64) << (7 * k)
    pairs = np.searchsorted(ends, sizes) // 2
    number = np.cumsum(each[0::2])
    first = pairs[:-1][np.diff(pairs) > 0]
    number -= np.repeat(number[first] - each[0::2][first], np.diff(np.r_[first, len(number)]))
    return pairs[lists], number, each[1::2]


def _by_chunk(columns: list[tuple[np.ndarray, ...]], what: str) -> pa.RecordBatch:
    seq, ids, number, value = (np.concatenate(c) for c in zip(*columns))
    order = np.lexsort((number, ids) if seq.min() == seq.max() else (number, seq, ids))
    seq, ids, number, value = seq[order], ids[order], number[order], value[order]
    begins = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (seq[1:] != seq[:-1])])
    return pa.RecordBatch.from_arrays([pa.array(ids[begins]), pa.array(seq[begins]), _packed(number, value, begins)], names=["id", "seq", what])


def _gathered(places: bool):
    """Rows of blocks (number, seq, ids, tfs or positions) as (id, seq, packed): a chunk's numbers with their counts, or their places, in one list for each time
    that GATHERED of them have come."""
    what = "positions" if places else "tfs"

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # so that a batch of frequent words doesn't come at once
                number, seq, ids, values = batch.slice(at, 64).columns
                each = pc.list_value_length(ids).to_numpy()
                number, seq, ids, values = np.repeat(number.to_numpy().astype(np.int32), each), np.repeat(seq.to_numpy(), each), ids.flatten().to_numpy(), values.flatten()
                if places:
                    each = pc.list_value_length(values).to_numpy()
                    number, seq, ids, values = np.repeat(number, each), np.repeat(seq, each), np.repeat(ids, each), values.flatten()
                held.append((seq, ids, number, values.to_numpy()))
                size += len(ids)
                if size >= GATHERED:
                    yield _by_chunk(held, what)
                    held, size = [], 0
        if size:
            yield _by_chunk(held, what)

    return run


class _Phrases:
    """Parts by the token that the fewest chunks hold, so that a chunk is only held against parts whose rarest token it has."""

    def __init__(self, parts: dict[int, list[int]], held: dict[int, int]):
        self.by: dict[int, list[tuple[int, list[int], int]]] = {}
        for part, tokens in parts.items():
            at = min(range(len(tokens)), key=lambda k: held[tokens[k]])
            self.by.setdefault(tokens[at], []).append((part, tokens, at))

    def found(self, number: np.ndarray, place: np.ndarray) -> dict[int, np.ndarray]:
        """Of a chunk's tokens, by number and place, the parts whose tokens follow each other, with the places where they begin."""
        token, at = np.unique(number, return_index=True)
        spans = dict(zip(token.tolist(), np.split(place, at[1:])))
        out = {}
        for t in spans:
            for part, tokens, k in self.by.get(t, ()):
                if all(x in spans for x in tokens):
                    begins = spans[t] - k
                    for j, x in enumerate(tokens):
                        if j != k and len(begins):
                            begins = begins[np.isin(begins + j, spans[x], assume_unique=True)]
                    if len(begins):
                        out[part] = begins
        return out

    def counted(self, row: np.ndarray, number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of many chunks' tokens, by row, number and place, the parts whose tokens follow each other, in order of row and part: row, part, and how often."""
        key = (row << 33) + (1 << 32) + place  # a place less that of a token in a part is still of its row
        order = np.lexsort((key, number))
        key = key[order]
        token, at = np.unique(number[order], return_index=True)
        spans = dict(zip(token.tolist(), np.split(key, at[1:])))
        out = []
        for t in spans:
            for part, tokens, k in self.by.get(t, ()):
                if all(x in spans for x in tokens):
                    begins = spans[t] - k
                    for j, x in sorted(enumerate(tokens), key=lambda y: len(spans[y[1]])):
                        if j != k and len(begins):
                            there = np.searchsorted(spans[x], begins + j)
                            begins = begins[spans[x][np.minimum(there, len(spans[x]) - 1)] == begins + j]
                    if len(begins):
                        rows, n = np.unique(begins >> 33, return_counts=True)
                        out.append((rows, np.full(len(rows), part), n))
        row, part, n = map(np.concatenate, zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((part, row))
        return row[order], part[order], n[order]


def _chunks(positions: pa.ListArray):
    """Numbers and places of each row, in order."""
    bounds, number, place = _unpacked(positions)
    order = np.lexsort((place, number, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))
    number, place = number[order], place[order]
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield number[begin:end], place[begin:end]


def _phrased(phrases: _Phrases, numbers: np.ndarray):
    """Rows with positions as rows whose `held` has the counts of the parts found in them too, under their numbers; chunks without any part go."""

    def run(batches):
        for batch in _sliced(batches, TOGETHER):
            bounds, number, place = _unpacked(batch.column(5))
            row, part, n = phrases.counted(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), number, place)
            rows, at = np.unique(row, return_index=True)
            found = dict(zip(rows.tolist(), _packed(numbers[part], n, at).to_pylist()))
            held = [[*lists, found[k]] if k in found else lists for k, lists in enumerate(batch.column(4).to_pylist())]
            kept = [k for k, lists in enumerate(held) if lists]
            rest = batch.take(pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rest.columns[:4], pa.array([held[k] for k in kept], pa.list_(pa.binary()))], names=["id", "length", "lift", "shown", "held"])

    return run


def _dense(phrases: _Phrases, numbers: list[list[int]], lengths: list[int], queries: np.ndarray, k: int, mode: str):
    """Cover densities of chunks for all queries, the best k of each; for "all" only of queries whose every part is there."""
    asked, wanted = ranking.Asked(numbers, len(lengths)), np.array(list(map(len, numbers)))

    def run(batches):
        top = ranking.Top(queries, k)
        for batch in _sliced(batches):
            for id_, lift, (number, place) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _chunks(batch.column(2))):
                found = phrases.found(number, place)
                if not found:
                    continue
                there = asked.sums(np.fromiter(found, np.int64, len(found)), np.ones(len(found)))
                hit, plain = (there == wanted if mode == "all" else there > 0) & (wanted > 0), np.zeros(len(queries))
                for q in np.flatnonzero(hit).tolist():
                    plain[q] = density([(found[p], lengths[p]) for p in numbers[q] if p in found], mode)
                top.add(id_, plain * lift, hit, plain)
        yield _hits_batch(top)

    return run


def _each(blocks: DataFrame, what: str = "positions") -> DataFrame:
    """A row for each chunk of rows of blocks, with its positions or tfs."""
    one = blocks.withColumn("_one", F.explode(F.arrays_zip("ids", what))).drop("ids", "tfs", "positions")
    return one.select("*", F.col("_one.ids").alias("id"), F.col(f"_one.{what}").alias(what)).drop("_one")


def parts_of(query: Column, mode: str) -> Column:
    """Parts of a query text: each search token's own tokens for "any"; of those that are no stop words, each for "all" and together for "phrase", if there are two."""
    if mode == "any":
        return F.filter(F.transform(text.search_tokens(query), ranking.tokens), lambda x: F.size(x) > 0)
    each = F.filter(F.transform(text.content_tokens(query), ranking.tokens), lambda x: F.size(x) > 0)
    some = F.when(F.size(text.content_tokens(query)) >= 2, each).otherwise(F.array().cast("array<array<string>>"))
    return some if mode == "all" else F.filter(F.array(F.flatten(some)), lambda x: F.size(x) > 0)


def density(parts: list[tuple[np.ndarray, int]], mode: str) -> float:
    """Cover density of the parts found in a chunk: where each begins, and its number of words (R4). A part alone is a cover for "any" and "phrase". For "all" the
    ends of places are walked, with the last place of each part: where the first of these moves on, once all places with that end are seen, what stands from
    there on is a cover, worth a word's weight over one and the words in it that are of no part. Words of parts in a cover are those that end by its end but for
    those that begin before it, as no place holds a cover within it."""
    begin, size = np.concatenate([b for b, _ in parts]), np.repeat([n for _, n in parts], [len(b) for b, _ in parts])
    if mode != "all":
        return DENSITY_SCALE * (WORD_WEIGHT * len(np.unique(begin)))
    part, end = np.repeat(np.arange(len(parts)), [len(b) for b, _ in parts]), begin + size - 1
    order = np.lexsort((begin, end))
    ended, began = np.cumsum(size[order]), np.argsort(begin, kind="stable")
    starts, before = begin[began], np.r_[0, np.cumsum(size[began])]
    closes = np.r_[end[order][1:] != end[order][:-1], True]
    last, first, score = [-1] * len(parts), -1, 0.0
    for b, e, p, words, close in zip(begin[order].tolist(), end[order].tolist(), part[order].tolist(), ended.tolist(), closes.tolist()):
        last[p] = b
        if close and (least := min(last)) > first:
            others = e - least + 1 - (words - int(before[np.searchsorted(starts, least)]))
            score, first = score + WORD_WEIGHT / (1 + max(0, others)), least
    return DENSITY_SCALE * score
