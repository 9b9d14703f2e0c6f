"""I-Match document fingerprints over randomised lexicon subsets.

The lexicon is what lies within a band of inverse document frequency, counted for each term over all documents; LEAST_SHARE and
LEAST_DOCS bound its size by 10,000 times the mean number of a document's terms. A document keeps its distinct lexicon terms in sorted order; each of
REPLICAS x SCALES random subsets of the lexicon, nested within a replica and halving from scale to scale, hashes the terms
that it holds, each distinct term once: as a sum of mixed values, so the order is immaterial. Likeness is the share of equal hashes among subsets that hold a term of either document, from the
sparsest subsets up to the first scale at which no subset is empty, where edits still leave some hashes alone.

Defined results: null text is empty; a document without any lexicon term keeps all its terms; without terms all
hashes are empty, and two such documents have a likeness of 1, else 0; equal texts have equal fingerprints; repeated rows
are documents of their own, next to each other in order; a null doc_id comes last; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, map_arrow, mix64

#: Terms counted at a time in a task before their counts are handed on.
COUNTED = 1 << 20
#: The band: terms in at least this many documents and this share of them, and at most this share.
LEAST_DOCS, LEAST_SHARE, MOST_SHARE = 2, 0.0001, 0.05
REPLICAS, SCALES = 20, 10
#: Ranges of doc_id in which neighbours are found; each needs a row on the driver.
MOST_RANGES, RANGE_ROWS = 10_000, 1_000
_HASH = Rolling(41)
_SEEDS = np.random.default_rng(42).integers(0, 2**64, REPLICAS, dtype=np.uint64)


def terms(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's words, lower-cased in A-Z."""
    raw = b" ".join(text.encode().lower().split())
    if not raw:
        return np.zeros(0, np.uint64)
    out = []
    while raw:  # a very long text by parts, cut between words
        cut = len(raw) if len(raw) <= 1 << 20 else (raw.find(b" ", 1 << 20) % (len(raw) + 1))
        data = np.frombuffer(raw[:cut], np.uint8)
        gaps = np.flatnonzero(data == 32)
        out.append(_HASH.slices(_HASH.prefix(data), np.r_[0, gaps + 1], np.r_[gaps, len(data)]))
        raw = raw[cut + 1 :]
    return np.unique(np.concatenate(out))


_PART = pa.schema([("term", pa.int64()), ("n", pa.int64())])


def _counted(sets: list[np.ndarray]) -> pa.RecordBatch:
    found, n = np.unique(np.concatenate(sets), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], schema=_PART)


def _count(batches):
    held, size = [], 0
    for batch in batches:
        for text in batch.column(0):
            held.append(terms(text.as_py() or ""))
            size += len(held[-1])
            if size >= COUNTED:
                yield _counted(held)
                held, size = [], 0
    if held:
        yield _counted(held)


def lexicon_of(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms within the band, each counted in all documents."""
    n = docs.count()
    counts = map_arrow(docs.select("text"), _count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = counts.where((F.col("n") >= max(LEAST_DOCS, LEAST_SHARE * n)) & (F.col("n") <= max(LEAST_DOCS, MOST_SHARE * n)))
    return np.sort(band.select("term").toArrow()["term"].to_numpy().astype(np.int64).view(np.uint64))


def fingerprint(text: str, lexicon: np.ndarray) -> np.ndarray:
    """REPLICAS x SCALES hashes of 16 bits, 0 where the subset holds none of the terms. A subset's hash is a mixed sum over
    its distinct terms."""
    found = terms(text)
    kept = found[lexicon[np.minimum(np.searchsorted(lexicon, found), len(lexicon) - 1)] == found] if len(lexicon) else found[:0]
    found = kept if len(kept) else found
    sums, some = np.zeros((REPLICAS, SCALES), np.uint64), np.zeros((REPLICAS, SCALES), bool)
    for k in range(0, len(found), 4096):
        draw, value = mix64(found[k : k + 4096] ^ _SEEDS[:, None]), mix64(~found[k : k + 4096])
        for scale in range(SCALES):
            members = draw < np.uint64((1 << (64 - scale)) - 1)
            held = members.any(1)
            if not held.any():
                break
            sums[:, scale] += (members * value).sum(1, dtype=np.uint64)
            some[:, scale] |= held
    return np.where(some, mix64(sums) % np.uint64(65535) + np.uint64(1), 0).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    held = (a != 0) | (b != 0)
    if not held.any():
        return 1.0
    full = np.flatnonzero(held.all(0))
    first = int(full[-1]) if len(full) else 0  # sparser subsets than this tell most
    return float(((a == b) & held)[:, first:].sum() / held[:, first:].sum())


def _compare(lexicon):
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches):
        kept = np.frombuffer(lexicon.value, np.uint64)
        last = None  # (range, is a copy, doc_id, text, fingerprint)
        for batch in batches:
            out = []
            for part, copy, doc, text in zip(*(batch.column(k) for k in ("part", "copy", "doc_id", "text"))):
                part, copy, doc, text = part.as_py(), copy.as_py(), doc.as_py(), text.as_py() or ""
                own = fingerprint(text, kept)
                if last and last[0] == part and not last[1]:
                    _, _, id_, old, print_ = last
                    n = len(old) // 2
                    edited = old[: len(old) - n] + text[:n]
                    other = fingerprint(edited, kept) if edited != old else print_
                    out.append((id_, len(old), hashlib.sha256(edited.encode()).hexdigest(), print_.astype(">u2").tobytes().hex(), other.astype(">u2").tobytes().hex(), likeness(print_, other), likeness(print_, own)))
                last = part, copy, doc, text, own
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 7, schema)], schema=schema)

    return run


def neighbours(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (part, copy, doc_id, text), sorted so that after each row that is no copy its next document
    stands, by descending doc_id and round to the first. One exchange of the texts; each range also gets the first row
    of the range after it, as a copy."""
    from pyspark.ml.feature import Bucketizer

    place = F.coalesce("doc_id", F.lit(-(2**63)))
    docs = docs.withColumn("place", place.cast("double"))
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts = docs.agg(F.percentile_approx("place", [k / ranges for k in range(1, ranges)] or [0.5], 100 * ranges)).first()[0] or []
    splits = [-float("inf"), *(sorted({float(x) for x in cuts}) if ranges > 1 else []), float("inf")]
    splits = splits if len(splits) > 2 else [-float("inf"), 0.0, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="place", outputCol="bucket", handleInvalid="keep")
    docs = cut.transform(docs).withColumn("part", (-F.col("bucket")).cast("int"))
    firsts = [(r.part, r.first) for r in docs.groupBy("part").agg(F.max("place").alias("first")).orderBy("part").collect()]  # a row for each range
    heads = [(firsts[k][0], firsts[(k + 1) % len(firsts)][1]) for k in range(len(firsts))]
    spark = docs.sparkSession
    heads = F.broadcast(spark.createDataFrame(heads, "of int, first double"))
    own = docs.select("part", F.lit(False).alias("copy"), "doc_id", "text")
    more = docs.join(heads, F.col("place") == F.col("first")).select(F.col("of").alias("part"), F.lit(True).alias("copy"), "doc_id", "text")
    return own.union(more).repartition("part").sortWithinPartitions("part", "copy", F.desc_nulls_last("doc_id"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of docs(doc_id, text), of its edited text (its last half replaced by the next document's
    first as many code points), and their likeness."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lexicon = docs.sparkSession.sparkContext.broadcast(lexicon_of(docs).tobytes())
    return map_arrow(neighbours(docs), _compare(lexicon), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
