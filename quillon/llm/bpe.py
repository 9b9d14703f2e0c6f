"""Byte-pair encoding and decoding by batched merge rounds in numpy.

The parts of many words stand end to end in one flat array of symbols. Each round looks up the pairs that changed by binary
search over the sorted keys of all merges, takes each part's lowest rank, and merges the places that have it in every part at once;
parts without a pair left leave the array. All places of a part with its lowest rank are merged in one round where no merge with the
new symbol has a lower rank (the file's ranks say so); else the leftmost alone, as one merge at a time would.

White space parts words and no part of a word crosses it, so a text's ids are those of its words one after another; ids of short words
are remembered in a table of bounded size. Texts are read in slices cut at white space: memory follows the longest run without any.

Defined results: null or empty text has no ids and decodes to an empty text; a special token's name in a text is that token; repeated rows
and rows without an id are encoded each; an empty table gives no rows; other columns are ignored. decode() leaves ids that the
vocabulary lacks out, as the tokenizers library does.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Words, of at most LONG bytes each, whose ids a task remembers; characters of text that are encoded at a time; ids decoded at a time.
REMEMBERED, LONG, SLICE, IDS = 400_000, 64, 2_000_000, 1_000_000
_NONE = np.int32(2**31 - 1)
_GAP = re.compile(r"[\x20\x09-\x0D]")
#: White space of any script.
_GAPS = re.compile(r"\s")
_PRINTABLE = bytes(range(33, 127))
#: ASCII in lower case; letters 1, digits 2, other bytes 0.
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_KIND = np.array([chr(c).isalpha() + 2 * chr(c).isdigit() if c < 128 else 0 for c in range(256)], np.uint8)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def sliced(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in parts of about `size` characters, cut at white space only."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


class Bpe:
    """A word-end BPE file: ids of texts, texts of ids, as the tokenizers library gives them."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        path = path or vocabulary_path()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        library = Tokenizer.from_file(path)
        self.normal, self.parts = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [c for c in range(256) if c not in shown]
        letter = {c: chr(c) for c in shown} | {c: chr(256 + k) for k, c in enumerate(hidden)}
        self.byte_at = np.zeros(512, np.uint8)
        self.byte_at[[ord(x) for x in letter.values()]] = list(letter)
        self.inner = np.array([vocab[letter[c]] for c in range(256)], np.int64)
        self.final = np.array([vocab[letter[c] + suffix] for c in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = 1 + max(vocab.values())
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys, rank = left * self.size + right, np.arange(len(pairs), dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], rank[order]
        first_use = np.full(self.size, _NONE)
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        self.together = first_use[self.made] > rank
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        self.tokens = {i: t.encode() for t, i in (vocab | special).items()}
        self.known: dict[bytes, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts of `sizes` bytes (1 or more) that stand end to end in data, and how many each has."""
        symbol, part = self.inner[data], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        n, last = len(sizes), np.cumsum(sizes) - 1
        symbol[last] = self.final[data[last]]
        rank = np.full(len(symbol), _NONE)
        within = np.ones(len(symbol), bool)
        within[last] = False
        within = np.flatnonzero(within)
        rank[within] = self._ranks(symbol[within], symbol[within + 1])
        done, sizes = [], np.asarray(sizes)
        while len(symbol):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank, starts)
            live = best < _NONE
            if not live.all():
                stay = np.repeat(live, sizes)
                done.append((part[~stay], symbol[~stay]))
                symbol, part, rank, best, sizes = symbol[stay], part[stay], rank[stay], best[live], sizes[live]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            leftmost = np.r_[True, part[at[1:]] != part[at[:-1]]]
            at = at[leftmost | self.together[rank[at]]]
            k = np.arange(len(at))  # of places that overlap, as in a run of one symbol, every second
            begun = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], k, 0))
            at = at[(k - begun) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            gone = np.bincount(np.searchsorted(np.cumsum(sizes), at, "right"), minlength=len(sizes))
            symbol, part, rank, sizes = symbol[stay], part[stay], rank[stay], sizes - gone
            at = at - np.arange(len(at))
            near = np.zeros(len(symbol), bool)
            near[at] = near[at[at > 0] - 1] = True
            at = np.flatnonzero(near)
            rank[at] = _NONE
            at = at[at + 1 < len(symbol)]
            at = at[part[at] == part[at + 1]]
            rank[at] = self._ranks(symbol[at], symbol[at + 1])
        parts, symbols = (np.concatenate([x[k] for x in done] or [np.zeros(0, np.int64)]) for k in (0, 1))
        return symbols[np.argsort(parts, kind="stable")], np.bincount(parts, minlength=n)

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the parts of printable ASCII words without an apostrophe, the parts' sizes, and how many parts each word has."""
        data = _LOWER[np.frombuffer(b"".join(words), np.uint8)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        kind, starts = _KIND[data], np.cumsum(sizes) - sizes
        begins = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == 2)] if len(data) else np.zeros(0, bool)
        begins[starts] = True
        return data, np.diff(np.r_[np.flatnonzero(begins), len(data)]), np.add.reduceat(begins, starts) if len(words) else sizes

    def _other(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of any words, normalised and parted by the file's rules: together, but for words with white space beyond ASCII, which may be parted in two
        or run into a neighbour's gap."""
        texts = [w.decode() for w in words]
        normal = self.normal(" ".join(texts))
        if normal.count(" ") == len(words) - 1 and not any(map(_GAPS.search, texts)):
            parts, ends = self.parts(normal), np.cumsum([len(w) + 1 for w in normal.split(" ")])
            counts = np.bincount(np.searchsorted(ends, [at for _, (at, _) in parts], "right"), minlength=len(words))
        else:
            each = [self.parts(self.normal(w)) for w in texts]
            parts, counts = [p for x in each for p in x], np.array([len(x) for x in each])
        letters = np.frombuffer("".join([p for p, _ in parts]).encode("utf-16-le"), "<u2")
        return self.byte_at[letters], np.array([len(p) for p, _ in parts], np.int64), counts

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words, merged all together."""
        plain = [w for w in words if w.isascii() and b"'" not in w]
        if b"".join(plain).translate(None, _PRINTABLE):
            plain = [w for w in plain if not w.translate(None, _PRINTABLE)]
        held = set(plain)
        other = [w for w in words if w not in held] if len(plain) < len(words) else []
        spaced = [w for w in other if _GAPS.search(w.decode())]
        if spaced:
            held = set(spaced)
            other = [w for w in other if w not in held]
        data, sizes, counts = (np.concatenate(x) for x in zip(*[f(w) for f, w in ((self._plain, plain), (self._other, other), (self._other, spaced)) if w]))
        ids, n = self.merge(data, sizes)
        ends = np.r_[0, np.cumsum(n)][np.cumsum(counts)].tolist()
        raw = ids.astype("<u4").tobytes()
        return {w: raw[4 * a : 4 * b] for w, a, b in zip(plain + other + spaced, [0, *ends], ends)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; all words that are not remembered go through the rounds together."""
        split = []
        for text in texts:
            runs = self.cut(text) if self.cut and "<|" in text else [text]
            split.append([r if k % 2 else r.encode().split() for k, r in enumerate(runs)])
        new = set().union(*(r for runs in split for r in runs[::2])).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*(r for runs in split for r in runs[::2]))
        learnt = self._learn(list(new)) if new else {}
        self.known.update(learnt)
        get = self.known.__getitem__
        out = [b"".join(self.special[r] if k % 2 else b"".join(map(get, r)) for k, r in enumerate(runs)) for runs in split]
        for word in learnt:
            if len(word) > LONG:
                del self.known[word]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8."""
        return b" ".join([t for t in map(self.tokens.get, np.frombuffer(ids, "<u4").tolist()) if t is not None])


def _slices(column: Iterable) -> Iterator[list[tuple[int, str]]]:
    """(row, part of its text) in lists of about SLICE characters."""
    held, size = [], 0
    for row, text in enumerate(column):
        for part in sliced(text.as_py() or ""):
            held.append((row, part))
            size += len(part)
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _encoded(path: str | None):
    def run(batches):
        bpe = Bpe(path)
        for batch in batches:
            out = [[] for _ in range(batch.num_rows)]
            for held in _slices(batch.column(1)):
                for (row, _), ids in zip(held, bpe.encode([part for _, part in held])):
                    out[row].append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(b"".join, out), pa.binary())], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of each row of docs(doc_id, text), without an exchange."""
    return map_arrow(_read(docs), _encoded(path), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of encoded(doc_id, ids); null ids are none."""

    def run(batches):
        bpe = Bpe(path)
        for batch in batches:
            texts = [bpe.decode(ids.as_py() or b"").decode() for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, text string")


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digested(path: str | None):
    def run(batches):
        bpe = Bpe(path)
        for batch in batches:
            n, of_ids, of_text = [0] * batch.num_rows, [hashlib.sha256() for _ in range(batch.num_rows)], [hashlib.sha256() for _ in range(batch.num_rows)]
            for held in _slices(batch.column(1)):
                for (row, _), ids in zip(held, bpe.encode([part for _, part in held])):
                    of_ids[row].update(ids)
                    for k in range(0, len(ids), 4 * IDS):
                        text = bpe.decode(ids[k : k + 4 * IDS])
                        of_text[row].update(b" " + text if n[row] or k else text)
                    n[row] += len(ids) // 4
            digests = [[h.hexdigest() for h in x] for x in (of_ids, of_text)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(d, pa.string()) for d in digests)], schema=_DIGESTS)

    return run


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them, for each row of docs(doc_id, text)."""
    return map_arrow(_read(docs), _digested(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
