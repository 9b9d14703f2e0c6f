"""Toxicity by a counterfactual-regularised classifier (counterfactual logit pairing).

Logistic regression over the presence of hashed words and word beginnings. Each training text that names a group is
also read with the name swapped for another of its kind, and the squared change of its logit is penalised, so that a group's
name alone doesn't move the score.

The classifier is fit on at most MOST_LABELLED labelled rows, taken in hash order of doc_id from those with
crc32(doc_id) mod 5 other than 0; scores are given to all rows by one pass without an exchange.

Defined results: null or empty text has the score of a text without known features; repeated rows score alike; labels
that are null, a doc_id whose labels differ, or rows without a document, are not learnt from; of a doc_id's rows one is, whichever has the least features; without both classes every score is the share of
toxic labels, 0 if there are none; an empty table gives no rows; other columns are ignored. Language, source, doc_id and
labels are no inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, map_arrow

MOST_LABELLED = 12_000
BITS, FEATURES, BEGINNINGS = 20, 1024, (4, 5, 6)
RIDGE, PAIRING, STEPS = 0.3, 1.0, 300

# Names of groups, by kind; a name may be swapped for any other in its line.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "american", "arab"),
    ("immigrant", "refugee", "citizen", "foreigner"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("deaf", "blind", "disabled", "autistic"),
    ("young", "old", "elderly"),
)
_SWAPS = {a.encode(): tuple(b.encode() for b in line if b != a) for line in IDENTITY_TERMS for a in line}
#: Bytes that are no part of a word: ASCII other than letters and digits.
_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_HASH = Rolling(91)


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_SPACES).split()


def features(found: list[bytes]) -> np.ndarray:
    """Numbers under 2**BITS of the words and their beginnings, with repeats."""
    out = []
    for k in range(0, len(found), 1 << 16):
        data = np.frombuffer(b" ".join(found[k : k + (1 << 16)]), np.uint8)
        gaps = np.flatnonzero(data == 32)
        start, end = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
        prefix = _HASH.prefix(data)
        out.append(_HASH.slices(prefix, start, end))
        for n in BEGINNINGS:
            long = start[end - start >= n]
            out.append(~_HASH.slices(prefix, long, long + n))
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int32) if out else np.zeros(0, np.int32)


def swapped(found: list[bytes]) -> list[bytes] | None:
    """The words with each group's name swapped for the next of its kind; None if none is named."""
    if not any(w in _SWAPS for w in found):
        return None
    return [_SWAPS[w][k % len(_SWAPS[w])] if w in _SWAPS else w for k, w in enumerate(found)]


_ROW = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("present", pa.binary()), ("other", pa.binary())])


def _read(batches):
    for batch in batches:
        out = []
        for doc, text, toxic in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("toxic").to_pylist()):
            found = words(text.as_py() or "")
            other = swapped(found)
            out.append((doc, toxic, np.unique(features(found)).tobytes(), None if other is None else np.unique(features(other)).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * len(_ROW), _ROW)], schema=_ROW)


def _dense(rows: list[np.ndarray], column: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(rows), n), np.float32)
    for k, row in enumerate(rows):
        at = column[row]
        out[k, at[at >= 0]] = 1
    return out


def fit(rows) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, numbers of the weighted features, weights. rows: (toxic, present, other or None) with features' numbers."""
    y = np.array([r[0] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(0, np.int32), np.zeros(0, np.float32)
    counts = np.zeros((2, 1 << BITS), np.float32)
    for r in rows:
        counts[r[0], r[1]] += 1
    share = (counts + 0.5) / (np.array([[(y == 0).sum()], [(y == 1).sum()]], np.float32) + 1)
    gap = np.abs(share[1] - share[0]) / np.sqrt((counts.sum(0) + 1) / len(y) * (1 + 1e-3 - counts.sum(0) / len(y)) + 1e-9)
    gap[counts.sum(0) < 3] = 0
    chosen = np.sort(np.argsort(-gap, kind="stable")[:FEATURES])
    chosen = chosen[gap[chosen] > 0].astype(np.int32)
    column = np.full(1 << BITS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    x = _dense([r[1] for r in rows], column, len(chosen))
    pairs = [k for k, r in enumerate(rows) if r[2] is not None]
    change = x[pairs] - _dense([rows[k][2] for k in pairs], column, len(chosen))
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()).astype(np.float32)  # both classes count alike
    w, b, m, v = np.zeros(len(chosen), np.float32), np.float32(0), 0.0, 0.0
    for t in range(1, STEPS + 1):  # Adam on all rows
        miss = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * weight
        slope = x.T @ miss + RIDGE / len(y) * w
        if len(pairs):
            slope += PAIRING / len(pairs) * (change.T @ (change @ w))
        g = np.r_[slope, miss.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - np.float32(step[-1])
    return float(b), chosen, w


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[float, np.ndarray, np.ndarray]:
    """Fit on at most `most` rows of labels(doc_id, toxic) that aren't held out. Their ids, so many at most, are broadcast to the texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = map_arrow(texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic"), _read, "doc_id long, toxic int, present binary, other binary")
    sample = read.groupBy("doc_id").agg(F.min(F.struct("toxic", "present", "other")).alias("row")).select("row.*").coalesce(8)  # one row a doc_id, so `most` at most
    rows = [(r.toxic, np.frombuffer(r.present, np.int32), None if r.other is None else np.frombuffer(r.other, np.int32)) for r in sample.toLocalIterator(prefetchPartitions=True)]
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))  # the same sums whatever the order of partitions
    return fit(rows)


def _score(model, keep):
    bias, chosen, weights = model

    def run(batches):
        table = np.zeros(1 << BITS, np.float32)
        table[chosen] = weights
        for batch in batches:
            out = []
            for text in batch.column("text"):
                at = features(words(text.as_py() or ""))
                at = np.unique(at[table[at] != 0])
                out.append(float(1 / (1 + np.exp(-np.clip(bias + np.sort(table[at]).sum(dtype=np.float64), -500, 500)))))
            kept = batch.select([k for k in batch.schema.names if k in keep])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.float64())], names=[*kept.schema.names, "score"])

    return run


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score for each row of docs(doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts, _score(model, ("doc_id",)), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    out = score(docs, train(docs, labels, most))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
