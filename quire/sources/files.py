"""Readers of text documents and of JSON-lines chunk stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "chunk_id string, book_id string, section string, text string, seq int, vector array<double>"


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, book_id (file name without extension), markdown of all .md and .txt files of a folder, not of its subfolders."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.{md,txt}", recursiveFileLookup=False)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return rows.select(F.input_file_name().alias("path"), F.url_decode(F.regexp_replace(name, r"\.(md|txt)$", "")).alias("book_id"), F.col("value").alias("markdown"))


def json_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON-lines store; blank lines are skipped, missing section, seq and vector become '', 0 and []."""
    rows = spark.read.schema(CHUNK).json(path).where("chunk_id is not null")
    return rows.withColumns({"section": F.coalesce("section", F.lit("")), "seq": F.coalesce("seq", F.lit(0)), "vector": F.coalesce("vector", F.array().cast("array<double>"))})


def write_json_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the books in `chunks` in a JSON-lines store with one folder per book."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").json(path)
