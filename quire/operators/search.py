"""Exact dense, lexical and hybrid retrieval over chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import dotted_numbers, words
from quire.functions.vectors import cosine
from quire.session import written

K1, B, RRF = 1.5, 0.75, 60


#: Bytes of query vectors or query terms that may be sent to every task.
SENT = 64 << 20
#: Terms and queries that are counted in one pass over the texts; signs of a word.
TERMS, SIGNS = 256, "0-9a-z가-힣"


def _products(asked, k: int):
    """The k best of each query among the rows of a batch; the rest of a batch can be no answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = {d: (names, unit(q)) for d, (names, q) in asked.value.items()}
        for batch in batches:
            ids, vectors = batch.columns
            sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for d, (names, q) in by_size.items():
                at = np.flatnonzero(sizes == d)
                if not len(at):
                    continue
                v = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
                with np.errstate(all="ignore"):
                    scores = q @ unit(v).T
                scores[~(scores > 0)] = -1  # NaN too
                most = k + len(at) - len(pc.unique(ids.take(pa.array(at))))  # places that repeats may take
                least = -np.partition(-scores, most - 1, axis=1)[:, most - 1 : most] if len(at) > most else -np.ones((len(q), 1))
                i, j = np.nonzero((scores >= least) & (scores > 0))  # ties of the last stay
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), ids.take(pa.array(at[j])), pa.array(scores[i, j])], names=["query", "chunk_id", "score"])

    return run


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at unit length; zero rows stay zero."""
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm == 0, 1, norm)


def dense(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, chunk_id, score, place: the k chunks with the highest positive cosine; ties by chunk_id.

    chunks: chunk_id, vector. queries: query, qvec. Queries of up to SENT bytes go to every task, which multiplies blocks
    and keeps its best; more of them are joined by vector length, salted by the chunk. A repeated chunk counts once.
    """
    kinds = dict(chunks.dtypes)["chunk_id"], dict(queries.dtypes)["query"]
    stated = queries.select("query", F.col("qvec").cast("array<double>").alias("qvec")).where("size(qvec) > 0")
    size = stated.agg(F.sum(8 * F.size("qvec"))).first()[0] or 0
    if size <= SENT:
        rows = stated.toArrow()
        lengths = rows.column("qvec").combine_chunks().value_lengths().to_numpy() if rows.num_rows else np.empty(0, np.int64)
        held = {}
        for d in np.unique(lengths).tolist():
            part = rows.take(pa.array(np.flatnonzero(lengths == d))).combine_chunks()
            flat = part.column("qvec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            held[d] = part.column("query").combine_chunks(), flat.reshape(-1, d)
        asked = chunks.sparkSession.sparkContext.broadcast(held)
        scored = chunks.select("chunk_id", "vector").mapInArrow(_products(asked, k), f"query {kinds[1]}, chunk_id {kinds[0]}, score double")
        return ranked(scored.groupBy("query", "chunk_id").agg(F.max("score").alias("score")), k)
    left = chunks.select("chunk_id", "vector", F.pmod(F.xxhash64("chunk_id"), F.lit(64)).alias("salt"))
    right = stated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    scored = left.join(right, (F.size("vector") == F.size("qvec")) & (left["salt"] == right["salt"]))
    scored = scored.select("query", "chunk_id", cosine(F.col("vector"), F.col("qvec")).alias("score")).where("score > 0 and not isnan(score)")
    return ranked(scored.groupBy("query", "chunk_id").agg(F.max("score").alias("score")), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their place."""
    by = Window.partitionBy("query").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def _counted(chunks: DataFrame, terms: list[str], asked: list[tuple[str, str]]) -> DataFrame:
    """chunk_id, length, hits (term, tf) and whole (queries whose text is in the chunk), in one pass over the texts."""
    low = F.lower(F.coalesce("text", F.lit("")))
    count = lambda t: F.regexp_count(low, F.lit(f"{t}(?<![{SIGNS}]{t})" + ("" if len(t) >= 4 else f"(?![{SIGNS}])")))
    tf = [F.struct(F.lit(t).alias("term"), F.when(F.contains(low, F.lit(t)), count(t)).otherwise(0).alias("tf")) for t in terms]
    whole = [F.when(F.contains(low, F.lit(text.lower())), F.lit(q)) for q, text in asked]
    none = F.array().cast("array<struct<term:string,tf:int>>")
    return chunks.select(
        "chunk_id",
        F.regexp_count(low, F.lit(f"[{SIGNS}]+")).alias("length"),
        F.filter(F.array(*tf), lambda x: x["tf"] > 0).alias("hits") if tf else none.alias("hits"),
        F.filter(F.array(*whole), lambda x: x.isNotNull()).alias("whole") if whole else F.array().cast("array<string>").alias("whole"),
    )


def _joined(chunks: DataFrame, queries: DataFrame, terms: DataFrame) -> DataFrame:
    """What _counted gives, for any number of queries: words meet terms, equal or by their beginnings, in an equi-join."""
    token, size = F.col("token"), F.length("token")
    starts = F.when(size > 4, F.concat(F.array(token), F.transform(F.sequence(F.lit(4), size - 1), lambda n: F.substring(token, F.lit(1), n)))).otherwise(F.array(token))
    docs = chunks.dropDuplicates(["chunk_id"]).select("chunk_id", words(F.col("text")).alias("tokens"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    found = docs.select("chunk_id", F.explode("tokens").alias("token")).select("chunk_id", F.explode(starts).alias("term"))
    tf = found.join(terms.select("term").distinct(), "term").groupBy("chunk_id", "term").agg(F.count("*").cast("int").alias("tf"))
    held = tf.groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf")).alias("hits"))  # at most the terms
    whole = docs.join(queries, F.contains("low", F.lower("text"))).groupBy("chunk_id").agg(F.collect_list("query").alias("whole"))
    out = docs.select("chunk_id", F.size("tokens").alias("length")).join(held, "chunk_id", "left").join(whole, "chunk_id", "left")
    return out.select("chunk_id", "length", F.coalesce("hits", F.array().cast("array<struct<term:string,tf:int>>")).alias("hits"), F.coalesce("whole", F.array().cast("array<string>")).alias("whole"))


def bm25(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, chunk_id, score, place by BM25 with light prefix stemming.

    chunks: chunk_id, text; repeated rows count once. queries: query, text. A term of four letters or more also counts
    words it begins. Where no chunk has a term of a query, chunks that contain its text score 0.5. Statistics cover all
    chunks. Up to TERMS terms are counted in one pass over the texts, of which only counts are kept and written once;
    more terms are joined with the words.
    """
    terms = queries.select("query", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    listed = [r[0] for r in terms.select("term").distinct().limit(TERMS + 1).collect()]
    stated = queries.select("query", "text").limit(TERMS + 1).collect()
    if max(len(listed), len(stated)) <= TERMS:
        counted = _counted(chunks, sorted(listed), [(r["query"], r["text"] or "") for r in stated])
    else:
        counted = _joined(chunks, queries, terms)
    docs = written(counted.dropDuplicates(["chunk_id"]))
    size = docs.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = docs.select("chunk_id", "length", F.inline("hits"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hits.join(df, "term").join(terms, "term").crossJoin(size).groupBy("query", "chunk_id").agg(F.sum(part).alias("score"))
    plain = terms.select("query").distinct().join(scored.select("query").distinct(), "query", "left_anti")
    fallback = docs.select("chunk_id", F.explode("whole").alias("query")).join(plain, "query").select("query", "chunk_id", F.lit(0.5).alias("score"))
    return ranked(scored.where("score > 0").unionByName(fallback), k)


def fused(rankings: list[DataFrame], k: int = RRF) -> DataFrame:
    """query, chunk_id, score: sum of 1 / (k + place) over the rankings a chunk is in."""
    rows = rankings[0].select("query", "chunk_id", "place")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("query", "chunk_id", "place"))
    return rows.groupBy("query", "chunk_id").agg(F.sum(1 / (F.lit(float(k)) + F.col("place"))).alias("score"))


def section_members(topics: DataFrame, chunks: DataFrame) -> DataFrame:
    """topic_id, chunk_id of the chunks whose heading holds one of the topic's section numbers, as whole numbers.

    Numbers are exploded on both sides, so this is an equi-join and not a test of all pairs.
    """
    wanted = topics.select("topic_id", "book_id", F.explode(F.array_distinct(F.transform(F.split(F.coalesce("section", F.lit("")), "[,;]"), lambda x: F.trim(x)))).alias("number")).where("number <> ''")
    have = chunks.select("chunk_id", "book_id", F.explode(F.array_distinct(dotted_numbers(F.col("section")))).alias("number"))
    return wanted.join(have, ["book_id", "number"]).select("topic_id", "chunk_id").distinct()


def hybrid(chunks: DataFrame, queries: DataFrame, primary: DataFrame, *, candidates: int = 30, keep: int = 10) -> DataFrame:
    """query, chunk_id, role, place: primary chunks by id, then the best fused others.

    chunks: chunk_id, text, vector. queries: query, text, qvec. primary: query, chunk_id.
    """
    others = fused([dense(chunks, queries, candidates), bm25(chunks, queries, candidates)]).join(primary, ["query", "chunk_id"], "left_anti")
    first = primary.select("query", "chunk_id").distinct().withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("chunk_id")))
    return first.select("query", "chunk_id", F.lit("primary").alias("role"), "place").unionByName(ranked(others, keep).select("query", "chunk_id", F.lit("crossref").alias("role"), "place"))


def back_filled(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The first ranking, filled up to k from the second with chunks not in it; both query, chunk_id, score, place."""
    more = second.join(first.select("query", "chunk_id"), ["query", "chunk_id"], "left_anti")
    rows = first.select("query", "chunk_id", "score", "place", F.lit("dense").alias("mode")).unionByName(more.select("query", "chunk_id", "score", "place", F.lit("lexical").alias("mode")))
    by = Window.partitionBy("query").orderBy("mode", "place")
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def overlap_score(title: Column, body: Column, query: Column, title_weight: int = 3, body_weight: int = 1) -> Column:
    """Weighted number of distinct query words in a title and a body."""
    q = F.array_distinct(words(query))
    return title_weight * F.size(F.array_intersect(words(title), q)) + body_weight * F.size(F.array_intersect(words(body), q))


def keywords(chunks: DataFrame, title: str, body: str, queries: DataFrame, k: int, title_weight: int = 3, body_weight: int = 1) -> DataFrame:
    """query, chunk_id, score, place: overlap_score over all chunks by an equi-join of words with the terms of the queries."""
    terms = queries.select("query", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    found = chunks.select("chunk_id", F.explode(F.array((F.struct(F.lit(title_weight).alias("w"), F.array_distinct(words(F.col(title))).alias("t"))), F.struct(F.lit(body_weight).alias("w"), F.array_distinct(words(F.col(body))).alias("t")))).alias("s"))
    found = found.select("chunk_id", F.col("s.w").alias("w"), F.explode("s.t").alias("term"))
    once = found.join(terms, "term").groupBy("query", "chunk_id", "term", "w").agg(F.lit(1).alias("one"))  # a repeated row counts once
    return ranked(once.groupBy("query", "chunk_id").agg(F.sum("w").cast("int").alias("score")), k)
