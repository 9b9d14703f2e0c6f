"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Every version of a text is addressed by its content (SHA-256). Only pairs of blob and rule version that the ledger lacks
are scanned, one row for each blob whatever its number of paths; findings are joined back to all rows with that content.
Positions come from the lengths of what lies between matches and of the matches themselves, in code points.

Defined results: null text is empty and has no findings; repeated rows each get their findings; an empty table gives no
rows; other columns are ignored. Spans of different kinds may overlap; those of one kind don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

# Base rules (kind, pattern, capture group that must be long, its least length) in their order.
BASE_RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
# Further rules (kind, pattern, what a text must contain to be worth the pattern).
MORE_RULES = (
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", "eyJ"),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----"),
    ("url", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/:@]{1,100}@", "://"),
)
RULE_VERSION = "2"
_SPAN = "array<struct<start:int,place:int,kind:string,end:int>>"
#: Matches that are folded at a time.
CHUNK = 256


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _folded(items: Column, start: Column, step, out, kind: str) -> Column:
    """out(state, item) of each item, as an array of `kind`, with states from start by step(state, item). Items go by chunks: an array
    grows by appending, which copies it, and by chunks only each chunk's results and the list of chunks are copied."""

    def of_chunk(state: Column, chunk: Column) -> Column:
        def add(inner: Column, item: Column) -> Column:
            return F.struct(step(inner["at"], item).alias("at"), F.concat(inner["found"], F.array(out(inner["at"], item))).alias("found"))

        done = F.aggregate(chunk, F.struct(state["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("found")), add)
        return _let(done, lambda x: F.struct(x["at"].alias("at"), F.concat(state["found"], F.array(x["found"])).alias("found")))

    def of_all(held: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / CHUNK).cast("int")), lambda k: F.slice(held, k * CHUNK + 1, CHUNK))
        return F.flatten(F.aggregate(chunks, F.struct(start.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("found")), of_chunk)["found"])

    return _let(items, lambda held: F.when(F.size(held) > 0, of_all(held)).otherwise(F.array().cast(f"array<{kind}>")))


def _spans(text: Column, kind: str, place: int, pattern: str, group: int, least: int) -> Column:
    def found(matches: Column) -> Column:
        def of(pieces: Column) -> Column:
            long = lambda m: F.char_length(F.regexp_extract(m, pattern, group) if group else m) >= least
            items = F.transform(matches, lambda m, k: F.struct(F.char_length(F.get(pieces, k)).alias("gap"), F.char_length(m).alias("size"), long(m).alias("long")))
            span = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), (at + x["gap"] + x["size"]).alias("end"), x["long"].alias("long"))
            every = _folded(items, F.lit(0), lambda at, x: at + x["gap"] + x["size"], span, "struct<start:int,place:int,kind:string,end:int,long:boolean>")
            return F.transform(F.filter(every, lambda x: x["long"]), lambda x: F.struct(x["start"].alias("start"), x["place"].alias("place"), x["kind"].alias("kind"), x["end"].alias("end")))

        return F.when(F.size(matches) == 0, F.array().cast(_SPAN)).otherwise(_let(F.split(text, pattern, -1), of))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def spans(text: Column) -> Column:
    """All spans of a text, by start and then by rule order."""
    parts = [_spans(text, kind, k, pattern, group, least) for k, (kind, pattern, group, least) in enumerate(BASE_RULES)]
    for k, (kind, pattern, sign) in enumerate(MORE_RULES, len(BASE_RULES)):
        parts.append(F.when(F.contains(text, F.lit(sign)), _spans(text, kind, k, pattern, 0, 1)).otherwise(F.array().cast(_SPAN)))
    return F.array_sort(F.concat(*parts))


def scan_unseen(blobs: DataFrame, ledger: DataFrame | None = None, version: str = RULE_VERSION) -> DataFrame:
    """The ledger (blob, version, spans) with what it lacks of blobs(blob, text) scanned and added."""
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("version") == version).select("blob"), "blob", "left_anti")
    found = blobs.select("blob", F.lit(version).alias("version"), spans(F.col("text")).alias("spans"))
    return found if ledger is None else ledger.select("blob", "version", "spans").union(found)


def scan(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(docs with columns blob and spans, the new ledger). Only blobs with findings are joined back."""
    docs = docs.withColumn("blob", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    blobs = docs.where(F.length("text") > 0).groupBy("blob").agg(F.first(F.col("text").cast("string")).alias("text"))
    ledger = scratch(scan_unseen(blobs, ledger, version), "ledger")
    found = ledger.where((F.col("version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    return docs.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPAN))), ledger


def scan_history(versions: DataFrame, path: str, version: str = RULE_VERSION) -> DataFrame:
    """versions(path, text, ...), historical ones too, with blob and spans, over a lasting ledger: the table at `path` gets the pairs of
    blob and rule version that it lacks, and is made if there is none. A run that was lost half-way leaves the pairs it wrote; a pair
    written twice says the same twice and is read once."""
    spark = versions.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = None
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        known = spark.read.schema(f"blob string, spans {_SPAN}, version string").parquet(path).where(F.col("version") == version)
    versions = versions.withColumn("blob", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    blobs = versions.where(F.length("text") > 0).groupBy("blob").agg(F.first(F.col("text").cast("string")).alias("text"))
    if known is not None:
        blobs = blobs.join(known.select("blob"), "blob", "left_anti")
    scan_unseen(blobs, None, version).select("blob", "spans", "version").write.mode("append").option("compression", "zstd").partitionBy("version").parquet(path)
    known = spark.read.schema(f"blob string, spans {_SPAN}, version string").parquet(path).where((F.col("version") == version) & (F.size("spans") > 0))
    found = known.groupBy("blob").agg(F.first("spans").alias("spans"))
    return versions.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPAN)))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of docs(doc_id, text)."""
    found, _ = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ledger)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["place"] < len(BASE_RULES))
    return found.select("doc_id", *(of(r[0]) for r in BASE_RULES), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by a mask."""
    gap = lambda at, x: F.struct(at.alias("start"), x["start"].alias("end"), (x["start"] >= at).alias("apart"))
    gaps = _folded(F.concat(spans, F.array(F.struct(F.char_length(text).alias("start"), F.lit(0).alias("place"), F.lit("").alias("kind"), F.char_length(text).alias("end")))), F.lit(0), lambda at, x: F.greatest(at, x["end"]), gap, "struct<start:int,end:int,apart:boolean>")
    # by code points in an array: a substring of a text counts its code points from the first
    between = lambda letters, x: F.array_join(F.slice(letters, x["start"] + 1, x["end"] - x["start"]), "")
    done = _let(F.split(text, "", -1), lambda letters: F.array_join(F.transform(F.filter(gaps, lambda x: x["apart"]), lambda x: between(letters, x)), mask))
    return F.when(F.size(spans) > 0, done).otherwise(text)
