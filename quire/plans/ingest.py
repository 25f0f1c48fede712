"""From documents to stored chunks with vectors: resumable, with a reason for every document left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.models import embedded
from quire.operators.markdown import chunked, looks_scanned, promoted_headings


def ingest(docs: DataFrame, held: DataFrame, make: Callable, *, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunks, report) of documents book_id, markdown, pages; held: book_id of books already stored.

    report: book_id, outcome ('ingested', 'skipped' or 'failed'), chunks, reason. A held book is skipped unless
    forced; one that looks scanned, or gives no chunk, fails. Models are called only for what is stored.
    """
    fresh = docs if force else docs.join(held.select("book_id").distinct(), "book_id", "left_anti")
    scanned = looks_scanned(F.col("markdown"), F.col("pages"))
    good = fresh.where(~scanned).select("book_id", promoted_headings(F.col("markdown")).alias("markdown"))
    chunks = embedded(chunked(good, "book_id", "markdown"), "text", make)
    counts = chunked(good, "book_id", "markdown").groupBy("book_id").agg(F.count("*").alias("chunks"))
    done = fresh.select("book_id", scanned.alias("scanned")).join(counts, "book_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    outcome = F.when(F.col("scanned") | (F.col("chunks") == 0), "failed").otherwise("ingested")
    reason = F.when(F.col("scanned"), "little text for its pages").when(F.col("chunks") == 0, "no text")
    report = done.select("book_id", outcome.alias("outcome"), "chunks", reason.alias("reason"))
    skipped = docs.select("book_id").join(fresh.select("book_id"), "book_id", "left_anti")
    return chunks, report.unionByName(skipped.select("book_id", F.lit("skipped").alias("outcome"), F.lit(0).cast("bigint").alias("chunks"), F.lit(None).cast("string").alias("reason")))
