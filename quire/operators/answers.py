"""Parts and values of generated answers."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import words


def problem_blocks(answers: DataFrame) -> DataFrame:
    """id, block, text: an answer cut before each 'Problem N' heading; without one the whole answer is block 1."""
    parts = F.filter(F.split(F.coalesce("answer", F.lit("")), r"(?im)^(?=\s*(?:#+\s*)?(?:\*\*)?problem\s+\d+)"), lambda x: x.rlike(r"\S"))
    rows = answers.select("id", F.posexplode(parts).alias("pos", "text"))
    return rows.select("id", (F.col("pos") + 1).alias("block"), "text")


def code_blocks(text: Column) -> Column:
    """Contents of fenced code, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)```[A-Za-z0-9_-]*\n(.*?)```"), 1))


def states_integer(text: Column, value: Column) -> Column:
    """Whether a whole number is written in a text, not as part of a longer number or a fraction."""
    return F.exists(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\d./])(\d+)(?!\d|\.\d)"), 1), lambda x: x == value.cast("string"))


def requested_count(text: Column) -> Column:
    """How many problems a request asks for: a number before the word, else two or three, else 1."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.regexp_extract(low, r"(\d+)\s*(?:problems|exercises|questions|문제)", 1).try_cast("int")
    named = F.when(low.rlike(r"\btwo\b|두\s*문제"), 2).when(low.rlike(r"\bthree\b|세\s*문제"), 3).otherwise(1)
    return F.when(found.isNotNull(), F.greatest(found, F.lit(1))).otherwise(named)


def all_code(first: Column, second: Column) -> Column:
    """Code of two texts, each block once, in order."""
    return F.array_distinct(F.concat(code_blocks(first), code_blocks(second)))


def with_result(text: Column, value: Column) -> Column:
    """The text with its result placeholder filled in."""
    return F.replace(text, F.lit("<<RESULT>>"), value.cast("string"))


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, text in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                tree = ast.parse(text or "")
            except (SyntaxError, ValueError):
                continue
            for n in ast.walk(tree):
                if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    called = sorted({c.func.id for c in ast.walk(n) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name)})
                    rows.append((path, n.name, "class" if isinstance(n, ast.ClassDef) else "function", ast.get_docstring(n) or "", n.lineno, called))
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
        cols = list(zip(*rows)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["path", "name", "kind", "doc", "line", "calls"])


def code_symbols(files: DataFrame) -> DataFrame:
    """path, name, kind, doc, line, calls of the functions and classes in Python files (path, text)."""
    return files.select("path", "text").mapInArrow(_symbols, "path string, name string, kind string, doc string, line int, calls array<string>")


def symbol_score(name: Column, doc: Column, query: Column) -> Column:
    """4 for each query word in a symbol's name, 2 for each in its description."""
    q = F.array_distinct(words(query))
    return 4 * F.size(F.array_intersect(words(F.regexp_replace(name, "_", " ")), q)) + 2 * F.size(F.array_intersect(words(doc), q))
