"""Removal of repeated byte strings by suffix arrays, sharded by content.

Every byte covered by a string of LENGTH bytes that starts anywhere else in the corpus goes. A start is compared only
where that can succeed: each start is owned by the least of the GRAM-byte hashes inside its string (leftmost of equals),
and equal strings have equal owners at equal offsets. A document thus falls into segments, one for each owner; the
owner's hash is the shard key, so equal strings meet in one shard whatever document they come from.

Segments with equal content are counted first, with map-side combine: a passage that stands word for word in a third of
the corpus arrives as one segment and a count. Different segments that share an owner go to shards of bounded size;
each shard sorts its suffixes by Larsson-Sadakane refinement, gets common prefixes by Kasai's method, and marks the starts
whose prefix with a neighbour reaches LENGTH.

An owner with more than HOT segments is divided by what stands beside it. Two of its segments with an equal string agree in
LENGTH - GRAM bytes around the owner, hence in half of these to the right or in half to the left: each segment goes to two
groups at most, by the hash of either side, and equal strings meet in one of them. Only a group that is still larger is
dealt over several shards at will; these hand on their distinct starts as runs sorted by hash, and runs are merged by
binary search.

Equal texts are one text, known by 128 bits of two hashes, in all but the last step: a row repeated any number of times is
sorted once.

Defined results: null text is empty; a text under LENGTH bytes keeps all; repeated rows are copies of each other, so all
their bytes go when they have LENGTH or more; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, forget, map_arrow, mix64, scratch

LENGTH, GRAM = 400, 64
#: Starts of one document handled at a time.
CHUNK = 1 << 20
#: Bytes of a shard; three 21-bit numbers must fit in a sort key.
SHARD = 1 << 20
#: Segments of one owner that go to the same shard.
HOT = 1024
#: Starts of divided owners that are merged at a time.
PART = 500_000

_HASH = Rolling(31)
_U = np.uint64


def owners(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(owner hash, first start, number of starts, owner's offset from the first) of each segment of a byte string."""
    n = len(data) - length + 1  # starts
    for base in range(0, n, CHUNK):
        part = data[base : base + CHUNK + length - 1]
        starts, places = len(part) - length + 1, len(part) - gram + 1
        prefix = _HASH.prefix(part)
        grams = mix64((prefix[gram:] - prefix[:-gram]) * _HASH.down[:places])
        low = (grams & _U(0xFFFFFFFFFF000000)) | np.arange(places, dtype=np.uint64)
        width, have = length - gram + 1, 1
        while have < width:  # least over a window, by doubling
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        owner = (low[:starts] & _U(0xFFFFFF)).astype(np.int64)
        first = np.r_[0, np.flatnonzero(np.diff(owner)) + 1]
        count = np.diff(np.r_[first, starts])
        yield grams[owner[first]], first + base, count, owner[first] - first


_SEGMENT = pa.schema([(k, pa.int64()) for k in ("k1", "k2", "owner", "high", "low", "start", "n", "offset")])


def _segments(length: int, gram: int):
    def run(batches):
        for batch in batches:
            out = [[] for _ in _SEGMENT]
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = text.as_py().encode()
                if len(raw) < length:
                    continue
                view = memoryview(raw)
                for owner, first, count, offset in owners(np.frombuffer(raw, np.uint8), length, gram):
                    digests = b"".join(xxhash.xxh3_128_digest(view[i : i + k]) for i, k in zip(first.tolist(), (count + length - 1).tolist()))
                    digests = np.frombuffer(digests, np.int64).reshape(-1, 2)
                    for k, x in enumerate((np.full(len(first), k1), np.full(len(first), k2), owner.view(np.int64), digests[:, 0] ^ offset, digests[:, 1] ^ count, first, count, offset)):
                        out[k].append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], schema=_SEGMENT)

    return run


def suffix_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of strings laid end to end, each followed by a place named in ends that sorts before all
    bytes and, among themselves, in order. Larsson-Sadakane: only places in groups not yet told apart are sorted again,
    by their group and the rank `depth` places on, and the depth doubles."""
    n, bits = len(data), 21
    assert n < 1 << bits
    digits = data.astype(np.uint64) + _U(1)
    digits[ends] = 0
    until = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # places to the string's end
    key = np.zeros(n, np.uint64)
    for k in range(4):
        moved = np.zeros(n, np.uint64)
        moved[: n - k] = digits[k:]
        key = key * _U(257) + np.where(until >= k, moved, _U(0))
    place = _U((1 << bits) - 1)
    packed = np.sort(key << _U(bits) | np.arange(n, dtype=np.uint64))
    order = (packed & place).astype(np.int64)
    packed >>= _U(bits)
    new = np.r_[True, packed[1:] != packed[:-1]] | (until[order] < 4)
    new[1:] |= new[:-1] & (until[order] < 4)[:-1]
    rank = np.empty(n, np.int64)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = start
    depth = 4
    alone = new & np.r_[new[1:], True]
    slots = np.flatnonzero(~alone)
    while len(slots):
        at = order[slots]
        packed = np.sort((rank[at].astype(np.uint64) << _U(bits) | rank[at + depth].astype(np.uint64)) << _U(bits) | at.astype(np.uint64))
        at = (packed & place).astype(np.int64)
        order[slots] = at
        packed >>= _U(bits)
        new = np.r_[True, packed[1:] != packed[:-1]]
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.r_[new[1:], True])]
        depth *= 2
    return order, rank


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each rank, the prefix shared with the rank before, by Kasai's method run along all strings at once: a place's
    prefix is at least its left neighbour's less one, so each string is passed over once."""
    n = len(data)
    first = np.r_[0, ends[:-1] + 1]
    sizes = ends - first
    until = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 1]
    shared, live = np.zeros(n, np.int64), np.argsort(-sizes, kind="stable")
    first, sizes = first[live], sizes[live]
    held = np.zeros(len(first), np.int64)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -k, "left"))  # strings longer than k
        i = first[:m] + k
        r = rank[i]
        j = order[np.maximum(r - 1, 0)]
        most = np.where(r > 0, np.minimum(until[i], until[j]), 0)
        got = np.minimum(np.maximum(held[:m] - 1, 0), most)
        open_ = np.flatnonzero(got < most)
        while len(open_):
            g = got[open_]
            x, y = eight[i[open_] + g], eight[j[open_] + g]
            same = np.where((x == y).all(1), 8, (x != y).argmax(1))
            g2 = np.minimum(g + same, most[open_])
            got[open_] = g2
            open_ = open_[(same == 8) & (g2 < most[open_])]
        held[:m] = got
        shared[r] = got
    return shared


def _marked(raws: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings laid end to end: where each begins, for each place whether the string of that length there stands
    elsewhere too, and whether the place is the first of those in suffix order."""
    sizes = np.array([len(x) for x in raws])
    data = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    order, rank = suffix_array(data, ends)
    reach = np.r_[common_prefixes(data, ends, order, rank), 0]
    return ends - sizes, (np.maximum(reach[:-1], reach[1:]) >= length)[rank], (reach[:-1] < length)[rank]


def _runs(flags: np.ndarray):
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())


_FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("part", pa.int64()), ("run", pa.binary())])
_START = np.dtype([(k, np.int64) for k in ("high", "low", "k1", "k2", "start")])


def _solve(rows: list[tuple], length: int, parts: int) -> pa.RecordBatch:
    """Spans of a shard's segments (of, owner, side, salt, salts, copies, k1, k2, start, bytes), and what it hands on: one sorted run
    of starts for each part of the hashes."""
    at, marked, first = _marked([x[-1] for x in rows], length)
    out, digests, places = [], [], []
    for (*_, salts, copies, k1, k2, start, raw), i in zip(rows, at.tolist()):
        flags = marked[i : i + len(raw) - length + 1]
        if copies == 1 and flags.any():
            out += [(k1, k2, start + a, start + b + length - 1, None, None) for a, b in _runs(flags)]
        if salts > 1:  # its group has other shards: hand on its distinct starts
            for k in np.flatnonzero(first[i : i + len(flags)]).tolist():
                digests.append(xxhash.xxh3_128_digest(raw[k : k + length]))
                places.append((k1, k2, start + k))
    if digests:
        starts = np.empty(len(digests), _START)
        starts["high"], starts["low"] = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
        starts["k1"], starts["k2"], starts["start"] = np.array(places, np.int64).T
        starts = starts[np.lexsort((starts["low"], starts["high"]))]
        part = starts["low"] % parts
        out += [(None, None, None, None, k, starts[part == k].tobytes()) for k in np.unique(part).tolist()]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * len(_FOUND), _FOUND)], schema=_FOUND)


def _sort_shards(length: int, shard_bytes: int, parts: int):
    """A shard is filled with whole groups as they arrive; a group is what shares owner, side and salt. Groups by the one and by
    the other side never share a shard, as the same segment may be in both."""

    def run(batches):
        held, size, last, cut, cut_size = [], 0, None, 0, 0
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                if x[:4] != last:
                    if held and x[0] != last[0]:
                        yield _solve(held, length, parts)
                        held, size = [], 0
                    last, cut, cut_size = x[:4], len(held), size
                held.append(x)
                size += len(x[-1]) + 1
                if size > shard_bytes and cut:
                    yield _solve(held[:cut], length, parts)
                    held, size, cut, cut_size = held[cut:], size - cut_size, 0, 0
        if held:
            yield _solve(held, length, parts)

    return run


def _merge(length: int):
    """Runs handed on by the shards of divided groups, for one part of the hashes: each start is sought among all by binary search.
    A start that came by both sides of its owner is one."""

    def run(frame):
        starts = np.unique(np.concatenate([np.frombuffer(x, _START) for x in frame["run"]]))
        keys = np.empty(len(starts), [("high", np.int64), ("low", np.int64)])
        keys["high"], keys["low"] = starts["high"], starts["low"]
        order = np.sort(keys, kind="stable")
        alone = np.searchsorted(order, keys, "right") - np.searchsorted(order, keys, "left") < 2
        found = starts[~alone]
        return pd.DataFrame({"k1": found["k1"], "k2": found["k2"], "start": found["start"], "end": found["start"] + length})

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with k1 and k2: what its text is known by."""
    return docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def _texts(docs: DataFrame) -> DataFrame:
    """One row for each different text, combined before it is shuffled."""
    return docs.groupBy("k1", "k2").agg(F.first("text").alias("text"))


def _divided(cut: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """Segments of owners with more than `hot` of them, in groups by the hash of either side of the owner."""
    right = (length - gram + 1) // 2
    left = length - gram - right + 1  # strings that agree in fewer bytes than `right` to the right do in so many to the left
    sides = F.array(
        F.when(F.octet_length("bytes") >= F.col("offset") + (gram + right), F.struct(F.lit(1).alias("of"), F.xxhash64(F.expr(f"substring(bytes, int(offset + {gram + 1}), {right})")).alias("hash"))),
        F.when(F.col("offset") >= left, F.struct(F.lit(2).alias("of"), F.xxhash64(F.expr(f"substring(bytes, int(offset - {left - 1}), {left})")).alias("hash"))),
    )
    rows = cut.withColumn("at", F.explode(F.filter(sides, lambda x: x.isNotNull()))).withColumns({"of": F.col("at.of"), "side": F.col("at.hash")}).drop("at")
    rows = scratch(rows, "sides")
    groups = rows.groupBy("of", "owner", "side").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest")).where("kinds > 1 and fewest = 1")
    salts = F.ceil(F.col("kinds") / hot).cast("long")
    rows = rows.join(groups.select("of", "owner", "side", salts.alias("salts")), ["of", "owner", "side"])
    return rows.withColumn("salt", F.pmod("high", "salts")).select(*_CUT)


_CUT = ("of", "owner", "side", "salt", "salts", "copies", "k1", "k2", "start", "bytes")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD) -> DataFrame:
    """(k1, k2, start, end): bytes of docs(k1, k2, text) covered by a string that stands elsewhere too; spans may overlap."""
    segments = scratch(map_arrow(docs.select("k1", "k2", "text"), _segments(length, gram), ", ".join(f"{f.name} long" for f in _SEGMENT)), "segments")
    kinds = segments.groupBy("owner", "high", "low").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "start", "n", "offset")).alias("first"))
    kinds = scratch(kinds, "kinds")
    whole = kinds.where("copies > 1").select("owner", "high", "low")
    spans = segments.join(whole, ["owner", "high", "low"]).select("k1", "k2", "start", (F.col("start") + F.col("n") + (length - 1)).alias("end")).distinct()
    spans = scratch(spans, "spans")
    forget(segments)
    several = kinds.groupBy("owner").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest")).where("kinds > 1 and fewest = 1")
    several = scratch(several, "several")
    wanted = kinds.join(several, "owner").select("owner", "high", "copies", "first.*", (F.col("kinds") > hot).alias("many"))
    cut = _texts(docs).select("k1", "k2", F.encode("text", "utf-8").alias("bytes")).join(wanted, ["k1", "k2"])
    cut = scratch(cut.withColumn("bytes", F.expr(f"substring(bytes, int(start + 1), int(n + {length - 1}))")).drop("n"), "cut")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    shards = cut.where("not many").withColumns({"of": F.lit(0), "side": none, "salt": none, "salts": one}).select(*_CUT)
    parts = 1
    if several.where(F.col("kinds") > hot).limit(1).count():
        divided = scratch(_divided(cut.where("many"), length, gram, hot), "divided")
        handed = (divided.where("salts > 1").count()) * (length - gram + 1)  # starts at most
        shards, parts = shards.union(divided), handed // PART + 1
    shards = shards.repartition("of", "owner", "side", "salt").sortWithinPartitions("of", "owner", "side", "salt")
    found = scratch(map_arrow(shards, _sort_shards(length, shard_bytes, parts), "k1 long, k2 long, start long, end long, part long, run binary"), "found")
    forget(kinds, several, cut)
    merged = found.where("part is not null").groupBy("part").applyInPandas(_merge(length), "k1 long, k2 long, start long, end long")
    return spans.union(found.where("part is null").select("k1", "k2", "start", "end")).union(merged)


_KEPT = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])


def _keep(with_bytes: bool):
    def run(batches):
        for batch in batches:
            out = []
            for k1, k2, text, spans in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text"), batch.column("spans").to_pylist()):
                raw, merged = text.as_py().encode(), []
                for span in sorted((x["start"], x["end"]) for x in spans or ()):
                    if merged and span[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], span[1])
                    else:
                        merged.append(list(span))
                kept = b"".join(raw[a:b] for a, b in zip([0, *(x[1] for x in merged)], [*(x[0] for x in merged), len(raw)]))
                out.append((k1, k2, len(raw), len(raw) - len(kept), len(merged), kept if with_bytes else None, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * len(_KEPT), _KEPT)], schema=_KEPT)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, unless with_bytes is off) and kept_sha256 of each row of docs(doc_id, text)."""
    docs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    spans = repeated_spans(docs, length, gram, hot, shard_bytes)
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # no more than a text's length allows
    out = _texts(docs).join(spans, ["k1", "k2"], "left").select("k1", "k2", "text", "spans")
    kept = map_arrow(out, _keep(with_bytes), "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return docs.select("doc_id", "k1", "k2").join(kept, ["k1", "k2"]).drop("k1", "k2")
