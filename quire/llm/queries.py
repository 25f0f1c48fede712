"""Queries of the operators for training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.mixing import mix, source_name
from quire.llm.neardup import groups, near_copies, pairs_of
from quire.llm.neighbours import graph_search, nearest, neighbour_graph
from quire.llm.packing import pack
from quire.llm.pairs import defective_pairs
from quire.llm.scans import find_noise, repair_noise
from quire.llm.splitting import split_oversized
from quire.llm.subjects import document_subjects
from quire.llm.tokenizer import token_counts
from quire.llm.topn import top_n
from quire.session import table


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_table, record_id, book_id, title, text of chunks and parsed books."""
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("record_table"), F.col("chunk_id").alias("record_id"), "book_id", F.col("section").alias("title"), "text")
    parsed = table(spark, sf_dir, "parsed_books").select(F.lit("parsed_books").alias("record_table"), F.col("path").alias("record_id"), "book_id", "title", F.col("markdown").alias("text"))
    return chunks.unionByName(parsed)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_noise(records(spark, sf_dir))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as continuous paragraphs."""
    return repair_noise(records(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "worker_results", "result_id", "run_id", "task", "output")
    return defective_pairs(results, table(spark, sf_dir, "tasks", "run_id", "task", "input"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of oversized texts."""
    books = table(spark, sf_dir, "books", "book_id", "chunk_profile", "added_at")
    return split_oversized(records(spark, sf_dir), books, table(spark, sf_dir, "chunk_profiles"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that had to be split: those with a second piece."""
    return p4_pieces(spark, sf_dir).where("piece = 2").select("record_table", "record_id")


def _close_chunks(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    vectors = table(spark, sf_dir, "chunks", "chunk_id", "vector").withColumnRenamed("chunk_id", "ident")
    members, _, edges = neighbour_graph(vectors, dim=64, **how)
    return nearest(members, edges, 5)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of at least 0.9."""
    close = _close_chunks(spark, sf_dir, close=0.9 - 1e-6, show=13, rounds=4, recall=0.98).where("similarity >= 0.9")
    return close.select(F.least("ident", "other").alias("chunk_a"), F.greatest("ident", "other").alias("chunk_b")).distinct()


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other chunks of every chunk."""
    return _close_chunks(spark, sf_dir, trees=12, leaf=1024, keep=24, show=16, rounds=3, refine=12, recall=0.9, part=24_576).select(F.col("ident").alias("chunk_id"), "place", F.col("other").alias("near_id"), "similarity")


def p5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every fiftieth row of embeddings, among all rows, by greedy graph search."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("ident"), F.col("embedding").alias("vector"))
    members, nodes, edges = neighbour_graph(vectors, dim=64, recall=0.92, k=10)
    asked = members.where("cast(ident as bigint) % 50 = 0").join(nodes, "node").select(F.col("ident").cast("bigint").alias("query"), "vec")
    found = graph_search(asked, nodes, edges, k=11).join(members, "node").where("cast(ident as bigint) <> query")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), F.col("ident").cast("bigint")))
    return found.select(F.col("query").alias("vec_id"), place.alias("place"), F.col("ident").cast("bigint").alias("near_id"), F.round("sim", 6).alias("similarity")).where("place <= 10")


def _chunk_copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = table(spark, sf_dir, "chunks", "chunk_id", "text").withColumnRenamed("chunk_id", "ident")
    return near_copies(texts, size=3, threshold=0.6)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(*_chunk_copies(spark, sf_dir)).select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every chunk."""
    return groups(*_chunk_copies(spark, sf_dir)).withColumnRenamed("ident", "chunk_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits", "book_id", "section", "chunk_id", "score").where("score > 0")
    best = top_n(hits.withColumn("section", F.coalesce("section", F.lit(""))), ["book_id", "section"], "chunk_id", "score", 5)
    return best.select("book_id", "section", "place", "chunk_id")


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ident and tokens of each document, a repeated doc_id once."""
    sizes = token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return sizes.groupBy("ident").agg(F.max("tokens").alias("tokens"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every document, or part of one, for each capacity of pack_sizes."""
    sizes = table(spark, sf_dir, "pack_sizes").where("name is not null and capacity_tokens > 0").collect()  # a small table; every task keeps windows of each
    placed = pack(sized_documents(spark, sf_dir), {r["name"]: r["capacity_tokens"] for r in sizes})
    return placed.withColumnRenamed("ident", "doc_id")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    sized = token_counts(docs, "doc_id", "text", {"source": source_name(F.col("source")), "text_key": F.sha2("text", 256)})
    return mix(sized, table(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen documents with their number of copies."""
    return _mixture(spark, sf_dir)[0].withColumnRenamed("ident", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mixture(spark, sf_dir)[1]


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_subjects(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "subject_samples"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sentences of the corpus per subject."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"))


QUERIES = {
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_nearest": p5_nearest,
    "p5_search": p5_search,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p7_found": p7_found,
    "p8_packed": p8_packed,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}
