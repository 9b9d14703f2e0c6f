"""The operators as stages of a pipeline: each takes documents and returns documents, but packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import mixing, near_dedup, packing, secret_scan, toxicity
from .common import map_arrow, scratch


#: Similarity in percent from which documents are near copies in the pipeline; op2 has a stricter one of its own.
NEAR = 80


def _column(name: str):
    """A column by its name, whatever the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def _row(docs: DataFrame):
    return F.struct(*[_column(c).alias(c) for c in docs.columns]).alias("_doc")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier of the folder's labels scores under 0.5; scored in the same pass, without an exchange.
    A row without an id or text is scored by its text, as any other; columns of any name and type are kept as they are."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = docs.select(_row(docs), F.col("text").cast("string").alias("text"))
    scored = map_arrow(held, toxicity._score(model, ("_doc",)), StructType([StructField("_doc", held.schema["_doc"].dataType), StructField("score", DoubleType())]))
    return scored.where("score < 0.5").select(*(F.col("_doc")[c].alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text with the least doc_id of each component of near copies, where each text is judged by itself, also beside others of its
    doc_id; of rows equal in doc_id and text the one whose other columns are least as JSON; and of rows without an id all."""
    names = docs.columns
    identified = docs.where("doc_id is not null")
    hashed = F.xxhash64(F.col("text").cast("string"))  # tells texts of one doc_id apart
    pairs = identified.select(F.col("doc_id").cast("long").alias("_id"), hashed.alias("_text"))
    many = pairs.groupBy("_id").agg(F.min("_text").alias("a"), F.max("_text").alias("b")).where("a <> b")
    if many.isEmpty():
        pairs, texts = pairs.withColumn("_number", F.col("_id")), identified.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    else:  # a number for each text of each doc_id
        pairs = scratch(pairs.distinct().withColumn("_number", F.monotonically_increasing_id()), "numbers")
        held = identified.select(F.col("doc_id").cast("long").alias("_id"), hashed.alias("_text"), F.col("text").cast("string").alias("text"))
        texts = held.join(pairs, ["_id", "_text"]).select(F.col("_number").alias("doc_id"), "text")
    parts = near_dedup.near_duplicates(texts, percent=NEAR).select(F.col("doc_id").alias("_number"), F.col("component_id").alias("_part"), (F.col("n_shingles") > 0).alias("_wordy")).distinct()
    alone = F.when(~F.col("_wordy"), F.col("_id"))  # a wordless text links with nothing, not even under another doc_id
    judged = pairs.join(parts, "_number").groupBy("_part", alone.alias("_alone")).agg(F.min(F.struct("_id", "_text")).alias("_kept"))
    kept = scratch(judged.select("_kept.*"), "kept")
    # aggregates, not a window: rows repeated any number of times are combined before they are shuffled
    rows = identified.select(F.col("doc_id").cast("long").alias("_id"), hashed.alias("_text"), _row(docs))
    others = F.struct(*[F.col("_doc")[c].alias(c) for c in names if c != "text"])
    one = rows.join(kept, ["_id", "_text"], "left_semi").withColumn("_others", others).groupBy("_id", "_text")
    one = one.agg(F.min_by("_others", F.to_json("_others")).alias("_others"), F.first("_doc.text").alias("_body"))
    return one.select(*((F.col("_body") if c == "text" else F.col("_others")[c]).alias(c) for c in names)).unionByName(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, found secrets masked in their texts. Null text stays null; repeated rows stay; columns of any name are kept as they are."""
    names = docs.columns
    found, _ = secret_scan.scan(docs.select(_row(docs).alias("doc"), F.col("text").cast("string").alias("text")))
    hit = F.size("spans") > 0
    values = {"text": secret_scan.masked(F.col("text"), F.col("spans"))}
    if "n_chars" in names:
        values["n_chars"] = F.when(hit, F.char_length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc")["n_chars"])
    out = found.withColumn("masked", values.pop("text"))
    values["text"] = F.when(hit, F.col("masked").cast(docs.schema["text"].dataType)).otherwise(F.col("doc")["text"])
    return out.select(*((values[c] if c in values else F.col("doc")[c]).alias(c) for c in names))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows as often as taken, the last one cut to the words taken. Rows without words are in no mix; a null source is one source; a very long text
    is taken by blocks; an empty table gives no rows; other columns, of any name, are kept as they are."""
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences and their token ids (little-endian unsigned 32-bit): sorted by sequence_id and
    offset they are the training sequences. Null text is the end token alone; rows repeated by the mix are packed each; a very long text is cut into
    pieces; an empty table gives no rows; other columns are ignored."""
    return packing.pack(docs)
