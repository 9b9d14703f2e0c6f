"""Packing token sequences by cutting-stock column generation.

A document's tokens, with an end token, are cut into pieces of CAPACITY and a tail. Full pieces are sequences of their
own. Tails are counted in a histogram of STEP-token classes (a fixed number of classes, whatever the corpus); a linear
program over patterns of classes finds the fewest sequences, its columns priced by a knapsack dynamic program over the
dual values. Pattern counts are rounded down, what remains is filled first-fit by decreasing length, and each class's
documents, ranked within and across shards, are assigned to the patterns' places.

Only piece lengths and checksums are planned; if ids are wanted, they are joined to the placed pieces in one exchange.

Defined results: null text is empty and is the end token alone; repeated rows are packed each; a null doc_id is packed
too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, scratch

CAPACITY, END, STEP = 2048, 1, 8
#: A plan within this share of the linear program's bound is good enough.
GAP = 0.001
#: Words whose ids a task remembers.
REMEMBERED = 400_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """The ids that the tokenizers library gives for a word-end BPE file, by way of a table of words seen.

    White space parts words, so a text's ids are those of its words, one after another. A new word is normalised and
    split as the file says, and its parts are merged by rank in tiktoken's core, the word-end mark being byte 255, which no
    UTF-8 text holds. A text with a special token's name goes to the library itself.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {}
        for token, id_ in spec["model"]["vocab"].items():
            if token not in self.special:
                ends = token.endswith("</w>") and len(token) > 4
                ranks[bytes(letters[c] for c in (token[:-4] if ends else token)) + b"\xff" * ends] = id_
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.library = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def _part(self, part: str) -> bytes:
        raw = part.encode()
        out = self.known.get(raw + b"\xff")
        if out is None:
            out = np.array(self.core.encode_single_piece(raw + b"\xff"), "<u4").tobytes()
            self._keep(raw + b"\xff", out)
        return out

    def _keep(self, key: bytes, ids: bytes) -> None:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[key] = ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if text.isalpha():
            return self._part(text)
        if text[-1] in ".,;:" and text[:-1].isalpha():
            return self._part(text[:-1]) + self._part(text[-1])
        return b"".join(map(self._part, self.split(text)))

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if "<|" in text and any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out, get = [], self.known.get
        for word in text.encode().split():
            ids = get(word)
            if ids is None:
                ids = self._word(word)
                self._keep(word, ids)
            out.append(ids)
        return b"".join(out)


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def _cut(path: str | None, capacity: int, end: int, with_ids: bool):
    def run(batches):
        encode = WordTokenizer(path or tokenizer_path())
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(encode(text.as_py() or "") + last)
                n = len(ids) // 4
                for k in range(0, n, capacity):
                    piece = ids[4 * k : 4 * (k + capacity)]
                    out.append((doc, k, len(piece) // 4, zlib.crc32(piece), n, bytes(piece) if with_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 6, _PIECE)], schema=_PIECE)

    return run


def column_generation(demand: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """(count, pattern) with pattern[i] pieces of i + 1 units, at most `size` units each, that hold all of the demand.

    The master program min sum(x), A x >= demand keeps a square basis; a pattern enters when its worth at the dual prices is
    over 1, found by an unbounded knapsack over the units."""
    m = size
    wanted = np.flatnonzero(demand)
    if not len(wanted):
        return []
    widths = wanted + 1
    basis = np.zeros((len(wanted), len(wanted)))
    np.fill_diagonal(basis, m // widths)  # as many of one width as fit
    need = demand[wanted].astype(float)
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ need
    for _ in range(10 * len(wanted)):  # few enough that updates of the inverse stay exact enough; counts are checked in integers
        price = inverse.sum(0)
        best, pick = np.zeros(m + 1), np.full(m + 1, -1)
        for room in range(1, m + 1):
            best[room] = best[room - 1]
            fit = np.searchsorted(widths, room, "right")
            if fit:
                worth = best[room - widths[:fit]] + price[:fit]
                k = int(worth.argmax())
                if worth[k] > best[room] + 1e-12:
                    best[room], pick[room] = worth[k], k
        if best[m] <= 1 + GAP:  # the bound is the present sum over this worth
            break
        pattern, room = np.zeros(len(wanted)), m
        while room > 0:
            if pick[room] < 0:
                room -= 1
            else:
                pattern[pick[room]] += 1
                room -= widths[pick[room]]
        along = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(along > 1e-9, np.maximum(x, 0) / along, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = x - ratio[out] * along
        x[out] = ratio[out]
        basis[:, out] = pattern
        row = inverse[out] / along[out]
        inverse = inverse - np.outer(along, row)
        inverse[out] = row
    left, plan = demand.astype(np.int64).copy(), []
    for k in np.argsort(-x, kind="stable"):
        count, pattern = int(np.floor(x[k] + 1e-9)), basis[:, k].astype(np.int64)
        used = pattern > 0
        count = min(count, int((left[wanted][used] // pattern[used]).min())) if used.any() else 0
        if count > 0:
            full = np.zeros(m, np.int64)
            full[wanted] = pattern
            left -= count * full
            plan.append((count, full))
    bins: list[tuple[int, np.ndarray]] = []  # what rounding left: first fit by decreasing length, in runs of equal bins
    while left.any():
        room, full = m, np.zeros(m, np.int64)
        for i in np.flatnonzero(left)[::-1]:
            k = min(int(left[i] - full[i]), room // int(i + 1))
            full[i] += k
            room -= k * int(i + 1)
        count = int((left[full > 0] // full[full > 0]).min())
        left -= count * full
        bins.append((count, full))
    return plan + bins


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, step: int = STEP, with_ids: bool = True) -> DataFrame:
    """Pieces of docs(doc_id, text) with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to
    and, unless with_ids is off, ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = map_arrow(docs, _cut(path, capacity, end, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    pieces = scratch((pieces if with_ids else pieces.drop("ids")).withColumn("piece", F.monotonically_increasing_id()), "pieces")  # fixed once written
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(1024))
    sized = pieces.drop("ids").withColumn("class", F.ceil(F.col("length") / step).cast("int")).withColumn("shard", shard)
    sized = sized.withColumn("class", F.when(F.col("length") == capacity, F.lit(0)).otherwise(F.col("class")))
    counts = scratch(sized.groupBy("class", "shard").agg(F.count("*").alias("n")), "histogram")
    # each shard's pieces of a class take the ranks after those of the shards before it: at most 1024 counts for a class
    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sized.withColumn("within", F.row_number().over(Window.partitionBy("class", "shard").orderBy("ids_crc32", "doc_id", "start")) - 1)
    ranked = ranked.join(counts.select("class", "shard", before.alias("before")), ["class", "shard"]).withColumn("rank", F.col("before") + F.col("within"))
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # capacity / step rows
    size = capacity // step
    plan = column_generation(np.array([histogram.get(i + 1, 0) for i in range(size)]), size)
    first, taken, places = histogram.get(0, 0), np.zeros(size, np.int64), []
    for count, pattern in plan:
        for i in np.flatnonzero(pattern):
            places.append((int(i) + 1, int(taken[i]), first, int(pattern[i])))
            taken[i] += count * pattern[i]
        first += count
    placed = map_arrow(ranked.drop("shard", "before", "within"), _place(places), ranked.drop("shard", "before", "within", "rank", "class").schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, slot long")
    within = Window.partitionBy("sequence_id").orderBy("slot")
    offset = F.coalesce(F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    used = F.sum("length").over(Window.partitionBy("sequence_id"))
    forms = F.when(F.array_contains(F.array(*[F.lit(1 << k).cast("long") for k in range(capacity.bit_length())]), used), used).otherwise(capacity)
    placed = placed.withColumn("offset", offset).withColumn("padded_to", forms.cast("long")).drop("slot")
    return placed.join(pieces.select("piece", "ids"), "piece").drop("piece") if with_ids else placed.drop("piece")


def _place(places: list[tuple[int, int, int, int]]):
    """Sequence and slot of a class's rank: places has (class, first rank, first sequence, pieces in each sequence), ranks ascending in a class."""
    by = {}
    for class_, rank, sequence, each in places:
        by.setdefault(class_, []).append((rank, sequence, each))
    by = {k: np.array(v).T for k, v in by.items()}

    def run(batches):
        for batch in batches:
            classes, ranks = batch.column("class").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, slot = ranks.copy(), np.zeros(len(ranks), np.int64)  # class 0: full pieces
            for k in np.unique(classes):
                if k:
                    at = np.flatnonzero(classes == k)
                    first, start, each = by[k]
                    j = np.searchsorted(first, ranks[at], "right") - 1
                    sequence[at] = start[j] + (ranks[at] - first[j]) // each[j]
                    slot[at] = -int(k) * 4096 + (ranks[at] - first[j]) % each[j]  # long pieces first
            kept = batch.drop_columns(["class", "rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence, pa.int64()), pa.array(slot, pa.int64())], names=[*kept.schema.names, "sequence_id", "slot"])

    return run
