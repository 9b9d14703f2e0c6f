"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

A document is its set of distinct five-word shingles over words lower-cased in A-Z. Each of 64 permutations of the
shingles' 64-bit hashes keeps both its minimum and its maximum, so 64 evaluations give 128 signature values; either
extreme is equal in two documents with a probability of their Jaccard similarity, hence the estimate is unbiased. 25
bands of five values miss a pair at similarity 0.85 with a probability of 4e-7, and one at 0.80 with 5e-5.

Copies with the same words are one class before any banding. Classes that share a bucket, directly or through others, are
one group: each bucket gives an edge from its least class to each other one, so edges are linear in bucket rows and no
bucket comes together anywhere. A group of up to BLOCK documents is intersected on full sets in one task, which hands on
only links that connect what is not connected yet. In a larger group

* each class is held against the least classes of its buckets on full sets, which connects most of what is connected;
* in buckets where several parts are left, signatures tell which classes are near one of another part at all;
* those are intersected on full sets by pairs of blocks, where a part of more than half a block has blocks of its own that
  are not paired with each other.

So a group of linked copies costs as much as its documents; what is near in a bucket without being linked goes by pairs
of blocks. Rows handed on are linear. The signatures may lose a link between parts of a large group: one pair in 55,500 at similarity 0.85 and one
in 48,900 at 0.80 (binomial over 128 values), and only where nothing else connects the two.

Defined results: null, empty or wordless text has no shingles and links with nothing; a text of under five words is one
shingle; repeated rows are one document and each keeps its row; where one doc_id has several texts, those of which it is the
least doc_id are one document, and each row has the component of its own text; a null doc_id links with nothing and is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, components, forget, map_arrow, mix64, scratch

WIDTH, PERMUTATIONS, BANDS, ROWS = 5, 64, 25, 5
#: Documents whose sets are intersected at a time; one of more than SHINGLES shingles counts as several.
BLOCK, SHINGLES = 2048, 2048
#: Signatures that are compared at a time.
SIGNATURES = 4096
#: Least classes of its buckets that a class of a large group is held against, those first with which it shares most buckets.
HUBS = 4
#: Words hashed at a time, so that memory for a very long text is bounded by its distinct shingles.
CHUNK = 1 << 16

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASH = Rolling(21)


def least_alike(percent: int) -> float:
    """Share of equal signature values under which two documents are not at the threshold, but for one pair in about 50,000: 4.5
    standard deviations of an estimate from 2 x PERMUTATIONS values."""
    share = percent / 100
    return share - 4.5 * (share * (1 - share) / (2 * PERMUTATIONS)) ** 0.5


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def shingles(found: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a word list's shingles."""
    if not found:
        return np.zeros(0, np.uint64)
    parts = []
    for k in range(0, max(1, len(found) - WIDTH + 1), CHUNK):
        data = np.frombuffer(b" ".join(found[k : k + CHUNK + WIDTH - 1]), np.uint8)
        gaps = np.flatnonzero(data == 32)
        start, end = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
        n = max(1, len(start) - WIDTH + 1)
        parts.append(_HASH.slices(_HASH.prefix(data), start[:n], end[-n:]))
    return np.unique(np.concatenate(parts))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation: 2 x PERMUTATIONS values."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(hashes), 512):
        block = hashes[k : k + 512, None] * _FACTORS
        np.minimum(low, block.min(0), out=low)
        np.maximum(high, block.max(0), out=high)
    return np.stack([low, high], 1).ravel()


def _sign(batches):
    for batch in batches:
        out = {"doc_id": [], "n_shingles": [], "key": [], "sig": [], "bands": []}
        for doc, text in zip(batch.column(0), batch.column(1)):
            found = words(text.as_py() or "")
            hashes = shingles(found)
            out["doc_id"].append(doc.as_py())
            out["n_shingles"].append(len(hashes))
            if not len(hashes):
                for k in ("key", "sig", "bands"):
                    out[k].append(None)
                continue
            values = signature(hashes)
            bands = mix64((mix64(values[: BANDS * ROWS].reshape(BANDS, ROWS)) * _BAND).sum(1))
            out["key"].append(hashlib.blake2b(b" ".join(found), digest_size=16).digest())
            out["sig"].append(mix64(values).astype(np.uint16).tobytes())
            out["bands"].append(bands.view(np.int64))
        yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))]))


def _rows(batches, key: int):
    rows = (x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, lambda x: x[:key])


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _batches(rows, schema: pa.Schema):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


def spanning_links(sets: list[np.ndarray], percent: int, part: np.ndarray | None = None):
    """Pairs (i, j) at the threshold, as many as connect all that is connected and not yet of one part; intersections are counted on full sets."""
    sizes = np.array([len(x) for x in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    held, part = np.zeros(len(values), np.int32), np.arange(len(sets)) if part is None else part.copy()
    for i in range(len(sets)):
        if (part == part[0]).all():
            return
        own = place[starts[i] : starts[i] + sizes[i]]
        held[own] = 1
        both = np.add.reduceat(held[place], starts)
        held[own] = 0
        for j in np.flatnonzero((100 * both >= percent * (sizes[i] + sizes - both)) & (part != part[i])):
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                yield i, int(j)


def _confirm(percent: int):
    """Links of each run of rows (key, part, rep, text), two blocks at most; rows of one part are linked already."""

    def links(batches):
        for _, group in _rows(batches, 1):
            _, parts, reps, texts = zip(*group)
            if len(set(parts)) > 1:
                at = np.unique(np.array(parts, np.int64), return_inverse=True)[1]
                yield from ((reps[i], reps[j]) for i, j in spanning_links([shingles(words(t)) for t in texts], percent, at))

    return lambda batches: _batches(links(batches), _PAIR)


def _hold(percent: int):
    """Links of each hub with its members; rows (hub, salt, member, rep, text), the hub's own texts first."""

    def links(batches):
        for (hub, _), group in _rows(batches, 2):
            own = []
            for _, _, member, rep, text in group:
                found = shingles(words(text))
                if not member:
                    own.append(found)
                    continue
                both = (len(np.intersect1d(x, found, assume_unique=True)) for x in own)
                if any(100 * n >= percent * (len(x) + len(found) - n) for x, n in zip(own, both)):
                    yield hub, rep

    return lambda batches: _batches(links(batches), _PAIR)


def _near(least: float):
    """Members of each run of rows (key, part, rep, sig), two blocks at most, that are as alike as that to one of another part."""

    def found(batches):
        for _, group in _rows(batches, 1):
            _, parts, reps, sigs = zip(*group)
            parts, sigs = np.array(parts, np.int64), np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), -1)
            near = np.zeros(len(parts), bool)
            for i in range(len(parts)):
                others = np.flatnonzero(parts[i + 1 :] != parts[i]) + i + 1
                alike = others[(sigs[others] == sigs[i]).mean(1) >= least] if len(others) else others
                near[alike] = True
                near[i] |= len(alike) > 0
            yield from ((reps[k],) for k in np.flatnonzero(near))

    return lambda batches: _batches(found(batches), pa.schema([("rep", pa.int64())]))


def paired(rows: DataFrame, key: str, block: int) -> DataFrame:
    """rows(key, part, rep, weight, ...) dealt to pairs of blocks of a key, column pair: rows of different parts meet in one pair at
    least. A part above half a block has blocks of its own, which are not paired with each other. Blocks, not rows, are
    joined with each other."""
    parts = rows.groupBy(key, "part").agg(F.sum("weight").alias("n"))
    parts = parts.withColumn("own", F.col("n") > block / 2).withColumn("unit", F.when(F.col("own"), F.col("part")).otherwise(F.lit(0).cast("long")))
    units = parts.groupBy(key, "own", "unit").agg(F.ceil(F.sum("n") / block).cast("int").alias("subs"))
    blocks = units.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.col("subs") - 1), lambda s: F.struct("own", "unit", s.alias("sub")))).alias("x"))
    other = blocks.withColumnRenamed("x", "y")
    apart = ~(F.col("x.own") & F.col("y.own") & (F.col("x.unit") == F.col("y.unit")))
    pairs = blocks.join(other, key).where((F.col("x") <= F.col("y")) & apart).withColumn("pair", F.xxhash64(key, "x", "y"))
    sub = F.pmod(F.xxhash64(F.when(F.col("own"), F.col("rep")).otherwise(F.col("part"))), F.col("subs")).cast("int")
    placed = rows.join(parts.drop("n"), [key, "part"]).join(units, [key, "own", "unit"])
    placed = placed.withColumn("z", F.struct("own", "unit", sub.alias("sub"))).drop("own", "unit", "subs", "weight")
    first = placed.join(pairs.select(key, F.col("x").alias("z"), "pair"), [key, "z"])
    return first.union(placed.join(pairs.where("x != y").select(key, F.col("y").alias("z"), "pair"), [key, "z"])).drop("z")


def _texts(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and text: the different texts of each of reps(rep), however often their rows are repeated."""
    held = docs.toDF("rep", "text").join(reps, "rep", "left_semi")
    return held.groupBy("rep", F.xxhash64("text").alias("h"), F.crc32("text").alias("c")).agg(F.first("text").alias("text")).select("rep", "text")


def _confirmed(rows: DataFrame, texts: DataFrame, key: str, percent: int) -> DataFrame:
    full = rows.select(key, "part", "rep").join(texts, "rep").select(key, "part", "rep", "text")
    return map_arrow(full.repartition(key).sortWithinPartitions(key), _confirm(percent), "a long, b long")


def _links_of_large(large: DataFrame, edges: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, block: int) -> DataFrame:
    """Links that connect all pairs at the threshold in groups that are more than a block; large(group, rep)."""
    texts = scratch(_texts(docs, large.select("rep")), "texts")
    of = edges.join(large.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("s"), "hub"))).alias("hubs"))  # BANDS at most
    held = of.select("rep", F.explode(F.slice("hubs", 1, HUBS)["hub"]).alias("hub"))
    salts = held.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    members = held.join(salts, "hub").select("hub", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"), "rep")
    hubs = salts.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("hub").alias("rep"))
    rows = members.union(hubs).join(texts, "rep").select("hub", "salt", "member", "rep", "text").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")
    stars = scratch(map_arrow(rows, _hold(percent), "a long, b long"), "stars")
    parts = components(stars).toDF("rep", "part")
    parts = scratch(large.join(parts, "rep", "left").select("group", "rep", F.coalesce("part", "rep").alias("part")), "parts")
    banded = classes.join(parts, "rep").select("part", "rep", F.explode("bands").alias("band"))
    open_ = banded.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("band")
    open_ = paired(banded.join(open_, "band").withColumn("weight", F.lit(1.0)), "band", SIGNATURES).select("pair", "part", "rep")
    signed = open_.join(classes.select("rep", "sig"), "rep").select("pair", "part", "rep", "sig").repartition("pair").sortWithinPartitions("pair")
    near = scratch(map_arrow(signed, _near(least_alike(percent)), "rep long").distinct(), "near")
    rest = parts.join(near, "rep").join(classes.groupBy("rep").agg(F.max("n_shingles").alias("n")), "rep")
    rest = paired(rest.select("group", "part", "rep", F.greatest(F.lit(1.0), F.col("n") / SHINGLES).alias("weight")), "group", block)
    out = scratch(stars.union(_confirmed(rest, texts, "pair", percent)), "links")
    forget(texts, stars, parts, near)
    return out


def _links(classes: DataFrame, docs: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) of representatives that connect all pairs at the threshold which share a bucket."""
    banded = classes.select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub != last").select("band", "hub")
    edges = banded.join(buckets, "band").where("rep != hub").groupBy("hub", "rep").agg(F.count("*").alias("shared"))
    edges = scratch(edges, "edges")
    weight = F.sum(F.greatest(F.lit(1.0), F.col("n_shingles") / SHINGLES))
    groups = components(edges, "hub", "rep").toDF("rep", "group").join(classes.groupBy("rep").agg(weight.alias("weight")), "rep")
    groups = scratch(groups, "groups")
    sizes = groups.groupBy("group").agg((F.sum("weight") > block).alias("large"))
    placed = scratch(groups.join(sizes, "group").select("group", "rep", "large"), "placed")
    small, large = placed.where("not large"), placed.where("large").select("group", "rep")
    out = scratch(_confirmed(small.withColumn("part", F.col("rep")), _texts(docs, small.select("rep")), "group", percent), "links")
    if large.limit(1).count():
        more = _links_of_large(large, edges, classes, docs, percent, block)
        both = scratch(out.union(more), "links")
        forget(out, more)
        out = both
    forget(edges, groups, placed)
    return out


def near_duplicates(docs: DataFrame, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs(doc_id, text); links at 100 * common >= percent * union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch(map_arrow(docs, _sign, "doc_id long, n_shingles long, key binary, sig binary, bands array<long>"), "signed")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = scratch(classes, "classes")
    links = _links(classes, docs, percent, block)
    parts = scratch(components(links), "parts")
    reps = classes.select("key", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    reps = scratch(reps, "membership")
    forget(classes, links, parts)
    out = signed.select("doc_id", "n_shingles", "key").join(reps, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
