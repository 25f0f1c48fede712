"""Which reader a source gets, and small configuration files."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parsers, and the one an extension stands for.
PARSERS = ("text", "fast", "docling")
BY_EXTENSION = {"txt": "text", "md": "text", "pdf": "fast"}


def parser_of(path: Column, *wishes: Column) -> Column:
    """The parser of a path: the first wish that is not null (of the book, then of the caller), else by extension; null where nothing tells."""
    ext = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in BY_EXTENSION.items() for x in pair))
    return F.coalesce(*wishes, F.try_element_at(known, ext))


def routed(sources: DataFrame) -> DataFrame:
    """sources (path, parser) with the parser each gets and `error`: what keeps a source from being read, else null."""
    rows = sources.withColumn("parser", parser_of(F.col("path"), F.col("parser")))
    said = (
        F.when(F.col("parser").isNull(), F.concat(F.lit("cannot infer parser for "), F.coalesce("path", F.lit("null"))))
        .when(~F.col("parser").isin(*PARSERS), F.concat(F.lit("unknown parser profile "), F.col("parser")))
    )
    return rows.withColumn("error", said)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path and change time of the .pdf, .md and .txt files of a folder, not of its subfolders, in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,md,txt}").option("recursiveFileLookup", "false").load(path)
    return files.select("path", F.col("modificationTime").alias("changed"), "length").orderBy("path")


def stale(files: DataFrame, began: Column) -> DataFrame:
    """Files (path, changed) that were not written since a run began."""
    return files.where(F.col("changed") <= began)


def parse_sources(spark: SparkSession, sources: DataFrame, readers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """path, markdown, pages, error of routed sources: each parser's rows go through its reader (path -> path, markdown, pages).

    A parser without a reader, or a source that cannot be routed, gives a row with its error.
    """
    rows = routed(sources).select("path", "parser", "error")
    lost = rows.withColumn("error", F.coalesce("error", F.when(~F.col("parser").isin(*readers), F.concat(F.lit("no reader for "), F.col("parser"))))).where("error is not null")
    out = lost.select("path", F.lit(None).cast("string").alias("markdown"), F.lit(None).cast("int").alias("pages"), "error")
    for name, read in readers.items():
        got = read(rows.where((F.col("parser") == name) & F.col("error").isNull()).select("path"))
        out = out.unionByName(got.select("path", "markdown", F.col("pages").cast("int").alias("pages"), F.lit(None).cast("string").alias("error")))
    return out


def rule_table(spark: SparkSession, path: str) -> DataFrame:
    """Rules of payloads (kind, slot, type, max, budget, field, field_budget, allowed) from a JSON file of kinds and slots."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    rows = []
    for kind, slots in json.loads(text)["kinds"].items():
        for slot, s in slots.items():
            for field, f in (s.get("fields") or {None: {}}).items():
                rows.append((kind, slot, s["type"], s.get("max"), s.get("budget"), field, f.get("budget"), f.get("allowed")))
    return spark.createDataFrame(rows, "kind string, slot string, type string, max int, budget int, field string, field_budget int, allowed array<string>")


def server_table(spark: SparkSession, config: dict[str, list[str] | str], defaults: dict[str, str]) -> DataFrame:
    """role, at, url: the servers of each role; a role without any has its default."""
    rows = []
    for role in {**defaults, **config}:
        urls = config.get(role) or defaults[role]
        urls = [u.strip() for u in urls.split(",")] if isinstance(urls, str) else list(urls)
        rows += [(role, k, u) for k, u in enumerate(u for u in urls if u)]
    return spark.createDataFrame(rows, "role string, at int, url string")


def write_notes(notes: DataFrame, path: str) -> None:
    """One folder of text for each topic (topic_id, markdown); what was there of these topics is replaced."""
    notes.select("topic_id", F.col("markdown").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("topic_id").text(path)


def write_report(spark: SparkSession, body: DataFrame, path: str, at: str) -> None:
    """A run's report (one row, report) below a line with its time."""
    body.select(F.concat(F.lit(f"<!-- {at} UTC -->\n\n"), F.col("report")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def profile(profiles: DataFrame, name: str) -> dict[str, int]:
    """Sizes of a chunk profile; KeyError with the known names when there is none."""
    rows = {r["name"]: r.asDict() for r in profiles.collect()}
    if name not in rows:
        raise KeyError(f"unknown profile {name!r}; known: {sorted(rows)}")
    return {k: v for k, v in rows[name].items() if k != "name"}
