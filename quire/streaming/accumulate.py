"""Incremental loads on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import shared_dir


def _status(spark: SparkSession, where: str):
    """What the file system says of a path, or None when nothing is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getFileStatus(path) if system.exists(path) else None


def accumulate(spark: SparkSession, folder: str, name: str, out: str, state: str, keys: list[str]) -> DataFrame:
    """Load what is new in a table since the last call into `out`, each key once; returns the accumulated rows.

    folder/name.parquet may be a file or a folder. The checkpoint in `state` remembers what was read, and a batch
    that is run again after a failure replaces its own files, so that a repeated call adds nothing.
    """
    source = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    # pathGlobFilter looks at the names of files only, so it would leave out all files of a table that is a folder
    stream = reader.parquet(source) if _status(spark, source).isDirectory() else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)

    def commit(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(keys)
        if _status(spark, out):
            fresh = fresh.join(spark.read.parquet(out).where(F.col("batch") < number).select(*keys), keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(commit).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def late_counts(hits: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Hits per day of search and book; rows later than the watermark are left out of closed days."""
    return hits.withWatermark("searched_at", lateness).groupBy(F.window("searched_at", "1 day"), "book_id").agg(F.count("*").alias("hits"))


def stream_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulated topics, each once."""
    import uuid

    base = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    return accumulate(spark, sf_dir, "topics", f"{base}/out", f"{base}/state", ["topic_id"]).select("topic_id", "book_id", "title")


QUERIES = {"stream_topics": stream_topics}
SQL = {"stream_topics": "SELECT DISTINCT topic_id, book_id, title FROM topics"}
