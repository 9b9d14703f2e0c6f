"""Markdown files as rows, with what their paths tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking

#: Blanks around titles and bodies of sections.
BLANK = " \t\r\n"


def with_path_metadata(files: DataFrame) -> DataFrame:
    """files(path, text) with agent_id, date and file_type read from the path."""
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    kind = F.when(F.col("path").contains("/weekly/"), "weekly").when(stem.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "daily").when(F.col("path").contains("/durable/"), "durable").otherwise("system")
    return files.withColumns({"agent_id": F.regexp_extract("path", "/agents/([^/]+)/", 1), "date": F.nullif(F.regexp_extract(stem, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")).cast("date"), "file_type": kind})


def scan(spark: SparkSession, root: str, least_chars: int = 20) -> DataFrame:
    """Every *.md under root: path, text, mtime, checksum; texts under least_chars are skipped."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("text"))
    return with_path_metadata(files.where(F.length("text") >= least_chars).withColumn("checksum", F.sha2("text", 256)))


def changed(files: DataFrame, seen: DataFrame, since: Column | None = None, least_chars: int = 0) -> DataFrame:
    """Files of least_chars or more, written after `since` if it is given, whose checksum isn't the one in seen(path, checksum)."""
    files = files.where(F.length("text") >= least_chars)
    return (files if since is None else files.where(F.col("mtime") > since)).join(seen.select("path", "checksum"), ["path", "checksum"], "left_anti")


def reindexed(chunks: DataFrame, files: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """chunks(id, place, chunk_id, parent_id, kind, content), id being the path, after files(path, text) were indexed anew and removed(path) were deleted."""
    gone = files.select("path") if removed is None else files.select("path").union(removed.select("path"))
    kept = chunks.join(gone.select(F.col("path").alias("id")), "id", "left_anti")
    return kept.unionByName(chunking.level_chunks(files.select(F.col("path").alias("id"), "text")).select(*chunks.columns))


def sections(docs: DataFrame) -> DataFrame:
    """docs(id, text) split on headings: id, section, title, body."""
    parts = F.split("text", r"(?m)^(?=#{1,6} )")
    out = docs.select("id", F.posexplode(F.filter(parts, lambda x: F.length(F.trim(x, F.lit(BLANK))) > 0)).alias("section", "part"))
    return out.select("id", "section", F.trim(F.regexp_extract("part", r"^#{1,6} ([^\n]*)", 1), F.lit(BLANK)).alias("title"), F.trim(F.regexp_replace("part", r"^#{1,6} [^\n]*\n?", ""), F.lit(BLANK)).alias("body"))
