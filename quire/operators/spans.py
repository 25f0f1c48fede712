"""Interval sets per entity as compressed run bitmaps.

Time (or pages, or any exact integer unit) is cut into shards of 2**SHARD_BITS units. Every shard of an
entity holds a compressed bitmap: run pairs while those are smaller, plain bits otherwise, so a shard never
takes more than 2**SHARD_BITS / 8 bytes however many spans fall into it. Partial bitmaps are made batch by
batch before the shuffle, united in two salted steps while streaming over sorted rows, and only the outer
runs of each shard meet in a window per entity. No step gathers the spans of one entity in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_BITS = 18
SALTS = 16

_PART = "entity string, shard bigint, bits binary"
_RUNS = "entity string, kind string, shard bigint, lo bigint, hi bigint, inner boolean"


def union_runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest runs covered by inclusive spans; adjacent spans join."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    start = np.r_[True, lo[1:] > top[:-1] + 1]
    last = np.r_[np.flatnonzero(start)[1:] - 1, len(lo) - 1]
    return lo[start], top[last]


def pack(lo: np.ndarray, hi: np.ndarray, bits: int = SHARD_BITS) -> bytes:
    """Disjoint sorted runs of one shard as bytes: runs ('r') or bits ('b'), whichever is smaller."""
    if 8 * len(lo) <= (1 << bits) // 8:
        return b"r" + np.stack([lo, hi], axis=1).astype("<u4").tobytes()
    step = np.zeros((1 << bits) + 1, np.int8)
    step[lo] += 1
    step[hi + 1] -= 1
    return b"b" + np.packbits(np.cumsum(step[:-1], dtype=np.int8).astype(bool)).tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if data[:1] == b"r":
        pairs = np.frombuffer(data, "<u4", offset=1).reshape(-1, 2).astype(np.int64)
        return pairs[:, 0], pairs[:, 1]
    held = np.unpackbits(np.frombuffer(data, np.uint8, offset=1)).astype(np.int8)
    step = np.diff(np.r_[np.int8(0), held, np.int8(0)])
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def _partial(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = batch.to_pandas()
            code = d.groupby(["entity", "shard"], sort=False).ngroup().to_numpy().astype(np.int64)
            first = np.unique(code, return_index=True)[1]
            step = (1 << bits) + 2
            lo, hi = union_runs(d["lo"].to_numpy(np.int64) + code * step, d["hi"].to_numpy(np.int64) + code * step)
            owner = lo // step
            ends = np.searchsorted(owner, np.arange(len(first) + 1))
            packed = [pack(lo[a:b] - k * step, hi[a:b] - k * step, bits) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(d["entity"].to_numpy()[first], pa.string()), pa.array(d["shard"].to_numpy()[first], pa.int64()), pa.array(packed, pa.binary())],
                names=["entity", "shard", "bits"],
            )

    return run


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """United runs of each (entity, shard) of rows sorted by both; holds one shard at a time."""
    key, lo, hi = None, np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        for entity, shard, data in zip(*(c.to_pylist() for c in batch.columns[:3])):
            if (entity, shard) != key:
                if key is not None:
                    yield *key, lo, hi
                key, (lo, hi) = (entity, shard), unpack(data)
            else:
                a, b = unpack(data)
                lo, hi = union_runs(np.r_[lo, a], np.r_[hi, b])
    if key is not None:
        yield *key, lo, hi


def _unite(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for entity, shard, lo, hi in _streamed(batches):
            rows.append((entity, shard, pack(lo, hi, bits)))
            if len(rows) >= 4096:
                yield _batch(rows, _ARROW_PART)
                rows = []
        if rows:
            yield _batch(rows, _ARROW_PART)

    return run


_ARROW_PART = pa.schema([("entity", pa.string()), ("shard", pa.int64()), ("bits", pa.binary())])
_ARROW_RUNS = pa.schema([("entity", pa.string()), ("kind", pa.string()), ("shard", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("inner", pa.bool_())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _extract(bits: int):
    """Set runs and clear runs inside a shard are final; the first and last set run go on as edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for entity, shard, lo, hi in _streamed(batches):
            base = shard << bits
            lo, hi = (lo + base).tolist(), (hi + base).tolist()
            rows.append((entity, "edge", shard, lo[0], hi[0], False))
            if len(lo) > 1:
                rows.append((entity, "edge", shard, lo[-1], hi[-1], True))
            rows.extend((entity, "period", shard, a, b, True) for a, b in zip(lo[1:-1], hi[1:-1]))
            rows.extend((entity, "gap", shard, b + 1, a - 1, True) for b, a in zip(hi[:-1], lo[1:]))
            while len(rows) >= 8192:
                yield _batch(rows[:8192], _ARROW_RUNS)
                rows = rows[8192:]
        if rows:
            yield _batch(rows, _ARROW_RUNS)

    return run


def coalesce_spans(spans: DataFrame, limits: DataFrame | None = None, *, bits: int = SHARD_BITS, salts: int = SALTS) -> DataFrame:
    """Periods and gaps of inclusive integer spans per entity.

    spans: entity, lo, hi. A null in any of them or lo > hi leaves a row out; repeats change nothing.
    limits: entity, first, last (optional, one row per entity). Gaps are listed within the limits of the
    entity; an entity without (usable) limits has gaps between its periods only; one with limits and no
    span is one gap. Periods are never clipped. Further columns of either input are ignored.
    Returns entity, kind ('period' or 'gap'), lo, hi. Empty input gives an empty result.
    """
    lo, hi = F.col("lo").cast("bigint"), F.col("hi").cast("bigint")
    valid = spans.select("entity", lo.alias("lo"), hi.alias("hi")).where("entity is not null and lo <= hi")
    valid = valid.withColumns({"first": F.shiftright("lo", bits), "last": F.shiftright("hi", bits)})
    base = lambda shard: F.shiftleft(shard, bits)
    begin = F.struct(F.col("first").alias("shard"), F.col("lo").alias("lo"), F.least("hi", base(F.col("first")) + ((1 << bits) - 1)).alias("hi"))
    end = F.struct(F.col("last").alias("shard"), base(F.col("last")).alias("lo"), F.col("hi").alias("hi"))
    cut = valid.select("entity", F.inline(F.when(F.col("first") == F.col("last"), F.array(begin)).otherwise(F.array(begin, end))))
    cut = cut.select("entity", "shard", (F.col("lo") - base(F.col("shard"))).alias("lo"), (F.col("hi") - base(F.col("shard"))).alias("hi"))
    parts = cut.mapInArrow(_partial(bits), _PART)
    parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    parts = parts.repartition("entity", "shard", "salt").sortWithinPartitions("entity", "shard").select("entity", "shard", "bits").mapInArrow(_unite(bits), _PART)
    runs = parts.repartition("entity", "shard").sortWithinPartitions("entity", "shard").mapInArrow(_extract(bits), _RUNS)
    periods, gaps = _stitched(runs)
    long = valid.where(F.col("last") - F.col("first") > 1).select("entity", base(F.col("first") + 1).alias("lo"), (base(F.col("last")) - 1).alias("hi"))
    if not long.isEmpty():  # shards that a span covers whole are one run, whatever their number
        over = long.select("entity").distinct()
        more, between = _swept(periods.join(over, "entity", "left_semi").select("entity", "lo", "hi").unionByName(long))
        periods = periods.join(over, "entity", "left_anti").unionByName(more)
        gaps = gaps.join(over, "entity", "left_anti").unionByName(between)
    return periods.unionByName(gaps) if limits is None else _limited(periods, gaps, limits)


def _swept(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(periods, gaps) of a few long spans per entity by a sweep in their order."""
    along = Window.partitionBy("entity").orderBy("lo", "hi")
    upto = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("before", upto)
    new = F.col("before").isNull() | (F.col("lo") > F.col("before") + 1)
    numbered = rows.withColumn("run", F.sum(new.cast("bigint")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    periods = numbered.groupBy("entity", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    gaps = rows.where("lo > before + 1").select("entity", F.lit("gap").alias("kind"), (F.col("before") + 1).alias("lo"), (F.col("lo") - 1).alias("hi"))
    return periods.select("entity", F.lit("period").alias("kind"), "lo", "hi"), gaps


def _stitched(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    along = Window.partitionBy("entity").orderBy("lo")
    before = F.lag("hi").over(along)
    edges = runs.where("kind = 'edge'").select("entity", "lo", "hi", "inner", before.alias("before"))
    new = F.col("before").isNull() | (F.col("lo") > F.col("before") + 1)
    edges = edges.select("*", F.sum(new.cast("bigint")).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    periods = edges.groupBy("entity", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("entity", F.lit("period").alias("kind"), "lo", "hi")
    between = edges.where("lo > before + 1 and not inner").select("entity", F.lit("gap").alias("kind"), (F.col("before") + 1).alias("lo"), (F.col("lo") - 1).alias("hi"))
    inside = runs.where("kind <> 'edge'").select("entity", "kind", "lo", "hi")
    return periods.unionByName(inside.where("kind = 'period'")), between.unionByName(inside.where("kind = 'gap'"))


def _limited(periods: DataFrame, gaps: DataFrame, limits: DataFrame) -> DataFrame:
    """Periods, and the gaps within the limits of each entity."""
    limits = limits.where("entity is not null and first <= last").select("entity", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))
    ends = periods.groupBy("entity").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    outer = limits.join(ends, "entity", "left").select(
        "entity",
        F.inline(
            F.expr(
                "case when lo is null then array(named_struct('lo', first, 'hi', last)) "
                "else array(named_struct('lo', first, 'hi', least(last, lo - 1)), named_struct('lo', greatest(first, hi + 1), 'hi', last)) end"
            )
        ),
    )
    inner = gaps.join(limits, "entity", "left").select(
        "entity",
        F.greatest("lo", F.coalesce("first", "lo")).alias("lo"),
        F.least("hi", F.coalesce("last", "hi")).alias("hi"),
    )
    gaps = inner.unionByName(outer).where("lo <= hi").select("entity", F.lit("gap").alias("kind"), "lo", "hi")
    return periods.unionByName(gaps)


RANGE = r"^\s*([0-9]{1,18})\s*[-‐‑‒–—―−]\s*([0-9]{1,18})\s*$"


def page_limits(page_range: Column) -> tuple[Column, Column]:
    """First and last page of 'A-B'; both null unless 1 <= A <= B with a hyphen or dash between."""
    first, last = (F.regexp_extract(page_range, RANGE, k).try_cast("bigint") for k in (1, 2))
    usable = (first >= 1) & (first <= last)
    return F.when(usable, first), F.when(usable, last)


def latest_range(books: DataFrame) -> DataFrame:
    """entity, first, last of each book's latest row by added_at; at equal times the greater page_range text, null last."""
    latest = books.where("book_id is not null").groupBy("book_id").agg(F.max(F.struct("added_at", "page_range")).alias("row"))
    first, last = page_limits(F.col("row.page_range"))
    return latest.select(F.col("book_id").alias("entity"), first.alias("first"), last.alias("last"))


def book_pages(books: DataFrame) -> DataFrame:
    """Held periods and missing pages of each book: book_id, kind, lo, hi.

    Spans with a null bound, lo < 1 or lo > hi do not count; null or empty `intervals` give no span.
    """
    spans = books.select(F.col("book_id").alias("entity"), F.inline("intervals")).where("lo >= 1 and lo <= hi")
    found = coalesce_spans(spans, latest_range(books))
    return found.select(F.col("entity").alias("book_id"), "kind", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))
