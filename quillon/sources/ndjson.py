"""Newline-delimited JSON in and out, with malformed lines set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(rows: DataFrame) -> DataFrame:
    """A JSON text, column value, for each row."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def parsed(texts: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON texts; a malformed one has nulls and its text in _corrupt_record."""
    full = f"{schema}, _corrupt_record string"
    row = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return texts.select(row.alias("row")).select("row.*")


def export(rows: DataFrame, path: str) -> None:
    lines(rows).write.text(path)


def load(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped texts): malformed rows and those without a required column are skipped, and so are rows tagged with _table."""
    texts = spark.read.text(path)
    bad = F.col("_corrupt_record").isNotNull() | F.coalesce(F.get_json_object("value", "$._table").isNotNull(), F.lit(False))
    for name in required:
        bad |= F.col(name).isNull()
    row = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = texts.select("value", row.alias("row")).select("value", "row.*")
    return rows.where(~bad).drop("value", "_corrupt_record"), rows.where(bad).select("value")
