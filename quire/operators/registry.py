"""Registry of books and topics: lookups, guarded changes, removal, and page spans already held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import dotted_numbers, slug
from quire.operators.spans import coalesce_spans
from quire.operators.store import upserted

# What the columns of books and topics may hold.
BOOK_STATUS = ("pending", "indexing", "indexed", "failed")
TOPIC_STATUS = ("todo", "draft", "review", "done")
KINDS = ("exam", "note", "problems")
SUBJECTS = ("math", "phys", "chem", "bio")


def chunks_of(chunks: DataFrame, *, book_id: str | None = None, section: str | None = None) -> DataFrame:
    """Chunks of a book and section, either of which may be left open, in the order of book, place and id."""
    for name, value in (("book_id", book_id), ("section", section)):
        if value is not None:
            chunks = chunks.where(F.col(name) == value)
    return chunks.orderBy("book_id", "seq", "chunk_id")


def topics_of(topics: DataFrame, *, book_id: str | None = None, status: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Topics by book, status and kind, oldest first; limit keeps the first ones."""
    for name, value in (("book_id", book_id), ("status", status), ("kind", kind)):
        if value is not None:
            topics = topics.where(F.col(name) == value)
    out = topics.orderBy("created_at", "topic_id")
    return out if limit is None else out.limit(limit)


def found(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The row of a key; KeyError when there is none."""
    out = rows.where(F.col(key) == value)
    if out.isEmpty():
        raise KeyError(f"unknown {key} {value!r}")
    return out


def guarded(column: Column, allowed: tuple[str, ...], name: str) -> Column:
    """The column, failing on a value that is not allowed; null passes."""
    said = F.concat(F.lit(f"invalid {name} "), column, F.lit(f"; expected one of {', '.join(allowed)}"))
    return F.when(column.isNull() | column.isin(*allowed), column).otherwise(F.raise_error(said))


def merged(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A registry with changed and added rows, its statuses and kinds checked."""
    rows = upserted(old, changes, key)
    allowed = {"status": TOPIC_STATUS if key == "topic_id" else BOOK_STATUS, "kind": KINDS}
    return rows.withColumns({c: guarded(F.col(c), allowed[c], c) for c in allowed if c in rows.columns})


def added(topics: DataFrame, new: DataFrame, books: DataFrame) -> DataFrame:
    """topics with new ones (topic_id, book_id, title, kind, section) whose book is registered and whose id is not.

    A null topic_id is made from the title; the subject is that of the book. The first of several new rows of an id, by title, stays.
    """
    subjects = books.groupBy("book_id").agg(F.max("subject").alias("subject"))
    rows = new.withColumn("topic_id", F.coalesce("topic_id", slug(F.col("title")))).join(subjects, "book_id")
    rows = rows.join(topics.select("topic_id"), "topic_id", "left_anti")
    first = Window.partitionBy("topic_id").orderBy("title", "book_id", "section")
    rows = rows.withColumn("rank__", F.row_number().over(first)).where("rank__ = 1").withColumn("status", F.lit("todo"))
    return topics.unionByName(rows.select([c for c in topics.columns if c in rows.columns]), allowMissingColumns=True)


def unregistered(sections: DataFrame, topics: DataFrame) -> DataFrame:
    """Discovered sections (book_id, number, ...) that no topic of the book stands for, by its id or by its section."""
    ident = slug(F.concat_ws("-", "book_id", "number"))
    by_id = sections.withColumn("id__", ident).join(topics.select(F.col("topic_id").alias("id__")).distinct(), "id__", "left_anti").drop("id__")
    named = topics.where("section is not null").select("book_id", F.col("section").alias("number")).distinct()
    return by_id.join(named, ["book_id", "number"], "left_anti")


def outline_sections(titles: DataFrame) -> DataFrame:
    """book_id, number, title of the numbered entries of outlines (book_id, at, title), each number once, the first."""
    number = F.nullif(F.regexp_extract(F.coalesce("title", F.lit("")), r"([0-9]+(?:\.[0-9]+)+)", 1), F.lit(""))
    rows = titles.select("book_id", number.alias("number"), F.struct("at", "title").alias("t")).where("number is not null")
    first = rows.groupBy("book_id", "number").agg(F.min("t").alias("t"))
    return first.select("book_id", "number", section_title(F.col("t.title")).alias("title"))


def section_title(heading: Column) -> Column:
    """A heading without its number and the signs around it; the heading itself where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(heading, r"^\s*[0-9]+(\.[0-9]+)*", ""), r"^[ :.\-]+|[ :.\-]+$", "")
    return F.when(bare == "", heading).otherwise(bare)


def discovered(chunks: DataFrame, topics: DataFrame) -> DataFrame:
    """book_id, number, title of the first heading of each section number of a book that no topic stands for."""
    rows = chunks.select("book_id", "section", "seq", F.explode(F.slice(dotted_numbers(F.col("section")), 1, 1)).alias("number"))
    first = rows.groupBy("book_id", "number").agg(F.min(F.struct("seq", "section")).getField("section").alias("heading"))
    known = topics.select("book_id", F.explode(dotted_numbers(F.col("section"))).alias("number")).distinct()
    return unregistered(first.join(known, ["book_id", "number"], "left_anti"), topics).select("book_id", "number", section_title(F.col("heading")).alias("title"))


def without_books(tables: dict[str, DataFrame], books: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given books (book_id); rows of no book stay."""
    gone = books.select("book_id").distinct()
    return {name: df.join(gone, "book_id", "left_anti") for name, df in tables.items()}


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def missing_spans(held: DataFrame, asked: DataFrame) -> DataFrame:
    """entity, lo, hi: the longest runs of asked pages that are not held; both entity, lo, hi with inclusive bounds.

    Spans are joined first, so only ends of runs are swept; a null or impossible span counts nowhere.
    """
    ends = []
    for df, h, a in ((held, 1, 0), (asked, 0, 1)):
        runs = coalesce_spans(df).where("kind = 'period'")
        ends.append(runs.select("entity", F.inline(F.array(F.struct(F.col("lo").alias("at"), F.lit(h).alias("h"), F.lit(a).alias("a")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-h).alias("h"), F.lit(-a).alias("a"))))))
    steps = ends[0].unionByName(ends[1]).groupBy("entity", "at").agg(F.sum("h").alias("h"), F.sum("a").alias("a"))
    along = Window.partitionBy("entity").orderBy("at")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    cut = steps.select("entity", F.col("at").alias("lo"), (F.lead("at").over(along) - 1).alias("hi"), F.sum("h").over(upto).alias("h"), F.sum("a").over(upto).alias("a"))
    return cut.where("a > 0 and h = 0 and hi is not null").select("entity", "lo", "hi")


def accumulated(held: DataFrame, asked: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): the rows of `pages` (entity, page, ...) that lie in asked but not yet held spans, and the spans held afterwards."""
    new = missing_spans(held, asked)
    hit = pages.join(new, (pages["entity"] == new["entity"]) & F.col("page").between(F.col("lo"), F.col("hi")), "left_semi")
    after = coalesce_spans(held.select("entity", "lo", "hi").unionByName(new)).where("kind = 'period'")
    return hit, after.select("entity", "lo", "hi")


def covers(spans: DataFrame, page: int) -> DataFrame:
    """entity and whether its spans (entity, lo, hi) hold a page."""
    return spans.groupBy("entity").agg(F.coalesce(F.bool_or((F.col("lo") >= 1) & F.lit(page).between(F.col("lo"), F.col("hi"))), F.lit(False)).alias("held"))
