"""Cutting oversized texts at natural boundaries by dynamic programming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import mixed_tokens

# Penalty of a cut by what precedes it; a size off the target by the whole target costs BALANCE.
PARAGRAPH, SENTENCE, LINE, CLAUSE, WORD, INSIDE = 0.0, 0.5, 1.0, 2.0, 4.0, 16.0
BALANCE = 3.0

_LEVELS = (
    (re.compile(r"\n[ \t]*\n\s*"), PARAGRAPH),
    (re.compile(r"[.!?。！？…][\"'”’)\]]*\s+"), SENTENCE),
    (re.compile(r"\n"), LINE),
    (re.compile(r"[,;:，、；：]\s+"), CLAUSE),
)
_SPACE = re.compile(r"\s+")

PIECES = "record_table string, record_id string, piece int, start int, end int, tokens int, text string"


def quarters(text: str) -> np.ndarray:
    """Running size in quarter tokens: 1 for an ASCII character, 4 for any other; tokens are ceil(size / 4)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(np.where(codes < 128, 1, 4), out=out[1:])
    return out


def _boundaries(text: str, q: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions and penalties; words, then single characters are offered only in gaps wider than `room`."""
    at: dict[int, float] = {}
    for pattern, penalty in _LEVELS:
        for m in pattern.finditer(text):
            at.setdefault(m.end(), penalty)
    at.pop(0, None)
    at[len(text)] = 0.0
    for finer in (True, False):
        known = np.array(sorted(at), np.int64)
        left = np.r_[0, known[:-1]]
        for a, b in zip(left[(w := q[known] - q[left] > room)].tolist(), known[w].tolist()):
            if finer:
                for m in _SPACE.finditer(text, a, b):
                    at.setdefault(m.end(), WORD)
            else:
                p = a
                while (p := int(np.searchsorted(q, q[p] + room, "right")) - 1) < b:
                    at.setdefault(p, INSIDE)
    positions = np.array(sorted(at), np.int64)
    return positions, np.array([at[p] for p in positions.tolist()])


def split_text(text: str, limit: int, overlap: int, target: int | None = None) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most `limit` tokens that cover the text; consecutive ones share `overlap` tokens.

    The cuts minimise penalties plus squared distance from the target size. Where less text than the overlap
    precedes a cut, all of it is shared. An overlap of half the limit or more is lowered to just under half.
    """
    limit = max(1, limit)
    q = quarters(text)
    if q[-1] <= 4 * limit:
        return [(0, len(text))]
    overlap = max(0, min(overlap, (limit - 1) // 2))
    target = max(1, min(target or limit, limit))
    room = 4 * max(1, (limit - overlap) // 2)
    ends, cost = _boundaries(text, q, room)
    starts = np.searchsorted(q, q[ends] - 4 * overlap, "left")
    for k in range(1, 4 if overlap else 0):  # of the starts that share the same number of tokens, prefer one after a space
        near = np.minimum(starts + k, ends)
        same = -(-(q[ends] - q[near]) // 4) == overlap
        better = same & np.fromiter((text[p - 1 : p].isspace() for p in near.tolist()), bool, len(near))
        better &= ~np.fromiter((p == 0 or text[p - 1 : p].isspace() for p in starts.tolist()), bool, len(near))
        starts = np.where(better, near, starts)
    starts = np.maximum.accumulate(np.r_[0, starts])  # before each piece: of the whole text, then after each cut
    head, tail = q[starts], q[ends]
    best, back = np.full(len(ends) + 1, np.inf), np.zeros(len(ends) + 1, np.int64)
    best[0] = 0.0
    first = np.searchsorted(head, tail - 4 * limit, "left")
    for k in range(len(ends)):
        a = first[k]
        sizes = -(-(tail[k] - head[a : k + 1]) // 4)
        total = best[a : k + 1] + BALANCE * ((sizes - target) / target) ** 2
        j = int(np.argmin(total))
        best[k + 1], back[k + 1] = total[j] + cost[k], a + j
    cuts, k = [], len(ends)
    while k:
        j = int(back[k])
        cuts.append((int(starts[j]), int(ends[k - 1])))
        k = j
    return cuts[::-1]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_table", "record_id", "piece", "start", "end", "tokens", "text"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for table, ident, text, limit, target, overlap in zip(*(c.to_pylist() for c in batch.columns)):
            for k, (a, b) in enumerate(split_text(text, limit, overlap, target)):
                part = text[a:b]
                wide = sum(c > "\x7f" for c in part) if not part.isascii() else 0
                rows.append((table, ident, k + 1, a, b, max(1, -(-(b - a - wide) // 4) + wide), part))
                size += b - a
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def book_limits(books: DataFrame, profiles: DataFrame) -> DataFrame:
    """book_id, limit, target, overlap of each book by its latest row; an unknown or null profile counts as 'default'."""
    latest = books.where("book_id is not null").groupBy("book_id").agg(F.max(F.struct("added_at", "chunk_profile")).getField("chunk_profile").alias("name"))
    sizes = profiles.select("name", F.col("max_tokens").alias("limit"), F.col("target_tokens").alias("target"), F.col("overlap_tokens").alias("overlap"))
    return latest.join(sizes, "name").drop("name")


def split_oversized(records: DataFrame, books: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pieces of every text over the max_tokens of its book's profile: record_table, record_id, piece, start, end, tokens, text.

    records: record_table, record_id, book_id, text. Rows with a null text or id, and texts within the limit,
    give no piece; repeated rows count once (of different texts under one id, the greatest). A book that is
    missing, or null, has the profile 'default'. Other columns are ignored. Empty tables give an empty result.

    Sizes are computed by built-in expressions; only texts over the least limit of all profiles are joined with
    their book, and only oversized ones reach Python. Grouping by record spreads a book with many rows.
    """
    sizes = {r["name"]: r for r in profiles.select("name", "max_tokens", "target_tokens", "overlap_tokens").dropDuplicates(["name"]).collect()}  # a small table of settings
    if "default" not in sizes:
        raise ValueError("profiles needs a row named 'default'")
    usual, least = sizes["default"], min(r["max_tokens"] for r in sizes.values())
    rows = records.select("record_table", "record_id", "book_id", "text").where("record_id is not null and text is not null")
    rows = rows.where((F.length("text") > least) & (mixed_tokens(F.col("text")) > least))
    rows = rows.join(book_limits(books, profiles), "book_id", "left")
    rows = rows.select(
        "record_table", "record_id", "text",
        F.coalesce("limit", F.lit(usual["max_tokens"])).alias("limit"),
        F.coalesce("target", F.lit(usual["target_tokens"])).alias("target"),
        F.coalesce("overlap", F.lit(usual["overlap_tokens"])).alias("overlap"),
    ).where(mixed_tokens(F.col("text")) > F.col("limit"))
    once = rows.groupBy("record_table", "record_id").agg(F.max(F.struct("text", "limit", "target", "overlap")).alias("r")).select("record_table", "record_id", "r.*")
    return once.mapInArrow(_split, PIECES)
