"""Markdown structure: noise, headings, sections, chunks and lint, as column expressions where they can be."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# TeX environments and macros that the renderer must not meet, and those it knows.
ENVIRONMENTS = "align align* equation equation* eqnarray gather split proof theorem lemma corollary definition matrix pmatrix bmatrix cases array".split()
MACROS = ["\\bm", "\\mathds", "\\text", "\\tag", "\\def", "\\color"]
KNOWN_MACROS = (
    "frac dfrac tfrac sqrt sum prod int iint iiint lim limsup liminf to mapsto infty cdot times left right left( right) left[ right] big Big "
    "bigg Bigg partial nabla binom approx equiv le ge ne pm mp div ldots cdots dots pi alpha beta gamma delta epsilon varepsilon theta lambda "
    "mu sigma phi varphi omega Gamma Delta Theta Lambda Sigma Phi Omega pi ln log exp sin cos tan cot sec csc sinh cosh tanh arcsin arccos "
    "arctan max min sup inf det ker dim"
).split()


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)


def clean_glyphs(text: Column) -> Column:
    """Glyph codes such as /H11005 and lines of a bare # out, white space in lines as one blank, blank lines dropped."""
    tidy = F.transform(lines(text), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"/H\d+", " "), r"\s+", " ")))
    return F.array_join(F.filter(tidy, lambda x: (x != "") & ~(F.startswith(x, F.lit("#")) & ~x.rlike("[A-Za-z0-9]"))), "\n")


def reads_as_prose(line: Column) -> Column:
    """At least three words of which, after the first, less than half begin with a capital."""
    rest = F.slice(F.split(F.trim(line), r"\s+"), 2, 10_000)
    capital = F.size(F.filter(rest, lambda w: w.rlike(r"^\p{Lu}")))
    return (F.size(rest) >= 2) & (capital < 0.5 * F.size(rest))


def promoted_headings(text: Column) -> Column:
    """Lines like '1.1 Basic Concepts' as '## ' headings, except in tables of contents, with page numbers or as prose."""
    rows = lines(clean_glyphs(text))
    hits = F.size(F.filter(rows, lambda x: x.rlike(r"^\s*\d+(?:\.\d+)+\.?\s+[A-Z].{0,80}$")))
    short = F.size(F.filter(rows, lambda x: (F.trim(x) != "") & (F.length(F.trim(x)) < 100)))
    contents = (F.size(rows) >= 6) & (short > 0) & (hits >= F.greatest(F.lit(6), F.floor(short / 2)))
    heading = lambda x: (F.length(x) <= 90) & x.rlike(r"^\d+(?:\.\d+)+\.?\s+[A-Z]") & ~x.rlike(r"\s+\d{1,4}\s*$") & ~reads_as_prose(x)
    return F.when(contents, clean_glyphs(text)).otherwise(F.array_join(F.transform(rows, lambda x: F.when(heading(x), F.concat(F.lit("## "), x)).otherwise(x)), "\n"))


def looks_scanned(text: Column, pages: Column) -> Column:
    """Less than 150 characters a page; false when the number of pages is not known."""
    return F.coalesce((pages > 0) & (F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")) < 150 * pages), F.lit(False))


def sections(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, section, ord, body: the text below each heading; headings without text vanish.

    A text without any body below its headings is one section with an empty name.
    """
    rows = docs.select(F.col(ident).alias("ident"), F.posexplode(lines(F.col(text))).alias("pos", "line"))
    head = F.regexp_extract("line", r"^#{1,6}\s+(.+?)\s*$", 1)
    rows = rows.withColumn("head", F.when(F.col("line").rlike(r"^#{1,6}\s+\S"), head))
    upto = Window.partitionBy("ident").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ord", F.count("head").over(upto)).withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(upto), F.lit("")))
    body = rows.where("head is null").groupBy("ident", "ord", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    body = body.where(F.col("body").rlike(r"\S"))
    whole = docs.select(F.col(ident).alias("ident"), F.lit(0).cast("bigint").alias("ord"), F.lit("").alias("section"), F.col(text).alias("body")).where(F.col("body").rlike(r"\S"))
    return body.unionByName(whole.join(body.select("ident").distinct(), "ident", "left_anti")).select("ident", "section", "ord", "body")


def _tokens(text: str) -> int:
    wide = 0 if text.isascii() else sum(c > "\x7f" for c in text)
    return max(1, -(-(len(text) - wide) // 4) + wide)


def _chunk(target: int, most: int, overlap: int):
    """Paragraphs packed greedily up to the target, one over the limit cut hard with overlap."""

    def cut(text: str) -> Iterator[str]:
        weight = [0]
        for c in text:
            weight.append(weight[-1] + (1 if c < "\x80" else 4))
        start = 0
        while True:
            end = start
            step = len(text) - start
            while step:  # largest end within the limit
                while end + step <= len(text) and -(-(weight[end + step] - weight[start]) // 4) <= most:
                    end += step
                step //= 2
            end = max(end, start + 1)
            yield text[start:end]
            if end >= len(text):
                return
            back = end
            while back > start and -(-(weight[end] - weight[back]) // 4) < overlap:
                back -= 1
            start = back if start < back < end else end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ident, section, ord_, body in zip(*(c.to_pylist() for c in batch.columns)):
                paragraphs = [" ".join(x.strip() for x in p.split("\n") if x.strip()) for p in re.split(r"\n[ \t]*\n", body)]
                held: list[str] = []
                pieces: list[str] = []
                for p in filter(None, paragraphs):
                    if held and (_tokens(p) > most or _tokens("\n\n".join([*held, p])) > most):
                        pieces.append("\n\n".join(held))
                        held = []
                    if _tokens(p) > most:
                        pieces.extend(cut(p))
                        continue
                    held.append(p)
                    if _tokens("\n\n".join(held)) >= target:
                        pieces.append("\n\n".join(held))
                        held = []
                if held:
                    pieces.append("\n\n".join(held))
                out += [(ident, section, ord_, k, p, _tokens(p)) for k, p in enumerate(pieces)]
            cols = list(zip(*out)) if out else [()] * 6
            types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["ident", "section", "ord", "part", "text", "tokens"])

    return run


def chunked(docs: DataFrame, ident: str, text: str, *, target: int = 400, most: int = 500, overlap: int = 60) -> DataFrame:
    """chunk_id, book_id, section, seq, text, tokens of documents with one row per ident."""
    parts = sections(docs, ident, text).select(F.col("ident").cast("string").alias("ident"), "section", F.col("ord").cast("bigint").alias("ord"), "body")
    pieces = parts.mapInArrow(_chunk(target, most, overlap), "ident string, section string, ord bigint, part int, text string, tokens int")
    seq = (F.row_number().over(Window.partitionBy("ident").orderBy("ord", "part")) - 1).cast("int")
    return pieces.withColumn("seq", seq).select(F.concat("ident", F.lit("-"), F.lpad(F.col("seq").cast("string"), 4, "0")).alias("chunk_id"), F.col("ident").alias("book_id"), "section", "seq", "text", "tokens")


def lint(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, line (0: whole text), message of math that would not render."""
    rows = docs.select(F.col(ident).alias("ident"), F.posexplode(lines(F.col(text))).alias("pos", "line"))
    dollars = F.regexp_count("line", F.lit(r"(?<!\\)\$"))
    env = F.regexp_extract("line", r"\\begin\{(" + "|".join(re.escape(e) for e in ENVIRONMENTS) + r")\}", 1)
    forbidden = F.filter(F.array(*map(F.lit, MACROS)), lambda m: F.contains(F.col("line"), m))
    known = r"^\\(?:" + "|".join(re.escape(m) for m in KNOWN_MACROS) + r")$"
    unknown = F.filter(
        F.regexp_extract_all("line", F.lit(r"(\\[a-zA-Z]+)"), 1),
        lambda m: ~m.rlike(known) & ~m.isin("\\begin", "\\end") & ~F.exists(F.array(*map(F.lit, MACROS)), lambda x: F.contains(m, x)),
    )
    found = F.concat(
        F.when(env != "", F.array(F.concat(F.lit("forbidden env '{"), env, F.lit("}'")))).otherwise(F.array().cast("array<string>")),
        F.transform(forbidden, lambda m: F.concat(F.lit("forbidden macro '"), m, F.lit("'"))),
        F.transform(unknown, lambda m: F.concat(F.lit("macro not in allowed set: '"), m, F.lit("'"))),
        F.when(dollars % 2 != 0, F.array(F.lit("odd number of '$' on line (unbalanced math)"))).otherwise(F.array().cast("array<string>")),
    )
    by_line = rows.select("ident", (F.col("pos") + 1).alias("at"), F.explode(found).alias("message")).withColumnRenamed("at", "line")
    count = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?<!\\)\$"))
    whole = docs.select(F.col(ident).alias("ident"), count.alias("n")).where("n % 2 <> 0")
    return by_line.unionByName(whole.select("ident", F.lit(0).alias("line"), F.concat(F.lit("unbalanced '$' across document (net "), F.col("n").cast("string"), F.lit(")")).alias("message")))


def without_fences(text: Column) -> Column:
    """The content of a text wrapped in one code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z0-9_-]*[ \t]*\r?\n?", ""), r"\r?\n?```$", ""))


def without_thinking(text: Column) -> Column:
    """Closed blocks of hidden reasoning out; an unclosed one stays."""
    return F.regexp_replace(text, r"(?s)<think>.*?</think>", "")


def dollar_math(text: Column) -> Column:
    r"""\[..\] as $$..$$ and \(..\) as $..$."""
    display = F.regexp_replace(text, r"(?s)\\\[(.*?)\\\]", r"\$\$$1\$\$")
    return F.regexp_replace(display, r"(?s)\\\((.*?)\\\)", r"\$$1\$")


def word_signature(text: Column) -> Column:
    """Words of a text without its math; equal for texts that differ in math only."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)\$\$.*?\$\$", " "), r"\$[^$\n]*\$", " ")
    return F.regexp_extract_all(bare, F.lit(r"([0-9A-Za-z가-힣]+)"), 1)


def without_nested_thinking(text: Column) -> Column:
    """Blocks of hidden reasoning out, nested ones too; an unclosed one hides the rest, a lone end mark goes."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)(</?think>|(?:(?!</?think>).)+)"), 1)
    zero = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        depth = F.when(x == "<think>", acc["depth"] + 1).when(x == "</think>", F.greatest(F.lit(0), acc["depth"] - 1)).otherwise(acc["depth"])
        keep = (acc["depth"] == 0) & ~x.isin("<think>", "</think>")
        return F.struct(depth.alias("depth"), F.when(keep, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    joined = F.array_join(F.aggregate(tokens, zero, step, lambda acc: acc["out"]), "")
    plain = F.when(F.contains(text, F.lit("think>")), joined).otherwise(text)
    return F.regexp_replace(plain, r"^\s+|\s+\z", "")


# Math between double and single dollars.
DISPLAY, INLINE = r"(?s)\$\$(.*?)\$\$", r"\$((?:\\.|[^$\\\n])*)\$(?!\$)"


def words_outside_math(text: Column) -> Column:
    """Lower-cased words of a text without its math, in order."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), DISPLAY, ""), INLINE, "")
    return F.transform(F.regexp_extract_all(bare, F.lit("([0-9A-Za-z가-힣]+)"), 1), F.lower)


def has_empty_math(text: Column) -> Column:
    """Whether a text has math without content."""
    shown = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DISPLAY), 1), F.trim)
    bare = F.exists(shown, lambda x: x.rlike(r"^\s*$") | x.isin("\\begin{aligned}", "\\end{aligned}"))
    return bare | F.exists(F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), DISPLAY, " "), F.lit(INLINE), 1), lambda x: x.rlike(r"^\s*$"))


def guarded_math(rows: DataFrame, ident: str, original: str, candidate: str) -> DataFrame:
    """ident, text, reason: the candidate where it changes nothing but math and renders, else the original with the reason."""
    said = lint(rows, ident, candidate).groupBy("ident").agg(F.min(F.struct(F.when(F.col("line") == 0, 2**31 - 1).otherwise(F.col("line")), F.col("message"))).getField("message").alias("issue"))
    held = rows.select(F.col(ident).alias("ident"), F.col(original).alias("original"), F.col(candidate).alias("candidate")).join(said, "ident", "left")
    reason = (
        F.when(words_outside_math(F.col("original")) != words_outside_math(F.col("candidate")), F.lit("non-math text changed"))
        .when(F.col("issue").isNotNull(), F.concat(F.lit("katex lint: "), F.col("issue")))
        .when(has_empty_math(F.col("candidate")), F.lit("empty math produced"))
        .otherwise(F.lit(""))
    )
    return held.select("ident", F.when(reason == "", F.col("candidate")).otherwise(F.col("original")).alias("text"), reason.alias("reason"))
