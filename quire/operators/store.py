"""Chunk store: reading, upserts, replacement and statistics per book."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stats(chunks: DataFrame) -> DataFrame:
    """book_id and number of chunks."""
    return chunks.groupBy("book_id").agg(F.count("*").alias("chunks"))


def next_seq(chunks: DataFrame) -> DataFrame:
    """book_id and the sequence number its next chunk gets."""
    return chunks.groupBy("book_id").agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("next_seq"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in by key; of several new rows of a key the last by all columns stays."""
    columns = new.columns
    last = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in columns if not dict(new.dtypes)[c].startswith("map")))
    once = new.withColumn("rank__", F.row_number().over(last)).where("rank__ = 1").drop("rank__")
    return old.join(once.select(key), key, "left_anti").select(*columns).unionByName(once)


def write_books(chunks: DataFrame, path: str) -> None:
    """Replace the partitions of exactly the books in `chunks`, others stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)


def without_book(chunks: DataFrame, book_id: str) -> DataFrame:
    return chunks.where(F.col("book_id") != book_id)


def appended(chunks: DataFrame, pieces: DataFrame) -> DataFrame:
    """pieces (book_id, ord, text, section) numbered after the last chunk of their book, with ids."""
    after = pieces.join(next_seq(chunks), "book_id", "left")
    seq = F.coalesce("next_seq", F.lit(0)) + F.row_number().over(Window.partitionBy("book_id").orderBy("ord")) - 1
    out = after.withColumn("seq", seq.cast("int"))
    return out.select(F.concat("book_id", F.lit("-"), F.lpad(F.col("seq").cast("string"), 4, "0")).alias("chunk_id"), "book_id", "section", "seq", "text")
