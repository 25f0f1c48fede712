"""Sessions, tables and the shared folder for intermediate results."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def local_session(cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A parquet table of the test data, pruned to the named columns when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode only a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quire-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(drop_written)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(*frames: DataFrame) -> None:
    """Delete what `written` wrote for frames that are no longer read, as the round before the last of a loop.

    Shuffle files go when the driver's collector finds their plans unreachable; it is asked to look now, since a
    long loop would otherwise keep the files of all its rounds.
    """
    spark = None
    for df in frames:
        spark = df.sparkSession
        for held in [x for x in _written if x[1] == getattr(df, "written_to", None)]:
            _written.remove(held)
            _delete(*held)
    if spark is not None:
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def drop_written() -> None:
    """Delete what `written` left behind; runs at exit, may be called between jobs."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return
