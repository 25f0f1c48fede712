"""Filling containers of fixed capacity by bounded-space best-fit packing."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import written

OPEN = 64
FAN_IN = 32
#: Share of open containers that a round of merging must free for another one.
LITTLE = 0.02

_PLACED = "name string, container string, done boolean, ident bigint, part int, first bigint, tokens bigint"
_ARROW = pa.schema([("name", pa.string()), ("container", pa.string()), ("done", pa.bool_()), ("ident", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("tokens", pa.int64())])
_MERGED = "name string, container string, into string, used bigint"
_ARROW_MERGED = pa.schema([("name", pa.string()), ("container", pa.string()), ("into", pa.string()), ("used", pa.int64())])


class Windows:
    """At most `limit` open containers of one capacity, kept by room left; items are opaque."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.rooms: list[tuple[int, int]] = []  # (room, number), least room first
        self.held: dict[int, list] = {}
        self.made = 0

    def put(self, size: int, item) -> tuple[int, list] | None:
        """Place an item best-fit; returns the container closed to make place, if any."""
        closed = None
        k = bisect_left(self.rooms, (size, -1))
        if k < len(self.rooms):
            room, number = self.rooms.pop(k)
        else:
            if len(self.rooms) >= self.limit:
                _, full = self.rooms.pop(0)
                closed = full, self.held.pop(full)
            room, number = self.capacity, self.made
            self.made += 1
            self.held[number] = []
        self.held[number].append(item)
        if room == size and closed is None:
            return number, self.held.pop(number)
        insort(self.rooms, (room - size, number))
        return closed


def _pack(capacities: list[tuple[str, int]], limit: int, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where = TaskContext.get().partitionId()
        windows = {name: Windows(capacity, limit) for name, capacity in capacities}
        rows: list[tuple] = []

        def close(name: str, number: int, items: list, done: bool) -> None:
            label = f"{name}-{mark}{where}-{number}"
            rows.extend((name, label, done, *item) for item in items)

        for batch in batches:
            for ident, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, capacity in capacities:
                    w, at = windows[name], 0
                    while at < size:  # only an item over the capacity has more than one part
                        part = min(capacity, size - at)
                        if (out := w.put(part, (ident, at // capacity + 1, at, part))) is not None:
                            close(name, *out, True)
                        at += part
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                rows.clear()
        for name, w in windows.items():
            for number, items in w.held.items():
                close(name, number, items, False)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return run


def _merge(capacities: dict[str, int]):
    """Best-fit decreasing over the leftovers of one partition; they come fullest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = {name: Windows(c, 1 << 30) for name, c in capacities.items()}
        rows: list[tuple] = []
        for batch in batches:
            for name, container, used in zip(*(c.to_pylist() for c in batch.columns)):
                if (out := windows[name].put(used, (container, used))) is not None:
                    rows.extend((name, c, out[1][0][0], u) for c, u in out[1])
        for name, w in windows.items():
            for items in w.held.values():
                rows.extend((name, c, items[0][0], u) for c, u in items)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW_MERGED)], schema=_ARROW_MERGED)

    return run


def pack(items: DataFrame, capacities: dict[str, int], *, open_windows: int = OPEN, fan_in: int = FAN_IN) -> DataFrame:
    """Assign items to containers of each capacity: name, container, ident, part, first, tokens.

    items: ident bigint, tokens bigint, one row per item; null or non-positive sizes have no row in the result.
    Only an item over the capacity is divided: into parts of the capacity and a rest, `first` being the offset
    of the part. Every partition keeps `open_windows` containers open, places best-fit, and closes the fullest
    when an item fits nowhere. What is open at the end of the partitions is merged in rounds: containers are drawn
    anew into tasks of about open_windows * fan_in of each capacity, which join them best-fit, until a round frees
    less than LITTLE of them or one task holds all. So no task grows with the data.
    Rows may repeat only if the caller's ids do. An empty table gives an empty result.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("capacities must be positive")
    rows = items.select(F.col("ident").cast("bigint").alias("ident"), F.col("tokens").cast("bigint").alias("tokens")).where("ident is not null and tokens > 0")
    placed = written(rows.mapInArrow(_pack(sorted(capacities.items()), open_windows, "p"), _PLACED))
    left = placed.where("not done").groupBy("name", "container").agg(F.sum("tokens").alias("used"))
    final, room, turn = None, max(2, open_windows * fan_in * len(capacities)), 0
    many = left.count()
    while True:
        parts = max(1, -(-many // room))
        merged = left.repartition(parts, F.xxhash64("container", F.lit(turn))).sortWithinPartitions(F.desc("used"), "container").mapInArrow(_merge(capacities), _MERGED)
        merged = written(merged)
        final = merged.select("name", "container", "into") if final is None else (
            final.join(merged.select("name", F.col("container").alias("into"), F.col("into").alias("next")), ["name", "into"]).select("name", "container", F.col("next").alias("into"))
        )
        left = merged.groupBy("name", "into").agg(F.sum("used").alias("used")).select("name", F.col("into").alias("container"), "used")
        before, many, turn = many, left.count(), turn + 1
        if parts == 1 or many > (1 - LITTLE) * before:
            break
    columns = ["name", "container", "ident", "part", "first", "tokens"]
    moved = placed.where("not done").join(final, ["name", "container"]).withColumn("container", F.col("into"))  # closed ones stay where they are
    return placed.where("done").select(*columns).unionByName(moved.select(*columns))
