"""Near-duplicate texts: an exact similarity join on word shingles by signature trees.

Two texts are near copies when the Jaccard similarity of their shingle sets reaches a threshold t. Texts with
equal sets are one node. For any common order of the tokens, sets with similarity t share a token among the
first |x| - ceil(t |x|) + 1 of each (of the smaller one, even among the first |x| - ceil(2 t |x| / (1 + t)) + 1),
so the trees may be parted by token without losing a link. Tokens are ordered by their counts over all texts,
kept in a table of fixed size; counts that share a slot only make the order less sharp, never the result wrong.

In a part, leaves hold nodes with equal least and greatest hash: a leaf keeps the union (OR) and the common bits (AND) of its
token bitmaps and the range of its sizes. Pairs of leaves under a token are pruned by the greatest overlap that
sizes and bitmaps allow, then the pairs of nodes below them, and what is left is checked on the full sets. A
token in more texts than `heavy` is spread over a grid of cells, so that no task meets all texts under it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import written

#: Slots of the count table (a power of two), bits of a bitmap in words of 64, postings of a token in one cell, pairs at a time.
SLOT_BITS, WORDS, HEAVY, CHUNK = 21, 4, 20_000, 1 << 20
#: Tokens of the texts for each part.
TOKENS = 4_000_000
#: Leaves under a token from which a product of bit matrices is cheaper than pairs one by one.
DENSE = 24

#: Words and the ends of texts; characters of texts read at a time.
_WORD, _END, READ = re.compile("[0-9a-z가-힣]+|\x00"), "\x00", 1 << 20
_P1, _P2, _P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Known(dict):
    """Hashes of words; that of the end of a text is 0."""

    def __missing__(self, word: str) -> int:
        found = self[word] = 0 if word == _END else xxhash.xxh64_intdigest(word) or 1
        return found


_known = _Known()


def _read(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_known) > 1_000_000:
        _known.clear()
    words = _WORD.findall(_END.join(t.replace(_END, " ") if _END in t else t for t in texts).lower())
    w = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    n = max(0, len(w) - size + 1)
    h, good, ends = np.zeros(n, np.uint64), np.ones(n, bool), w == 0
    for k in range(size):
        h = (h * _P1) ^ (w[k : k + n] * _P2)
        h ^= h >> np.uint64(31)
        good &= ~ends[k : k + n]
    h *= _P3
    h ^= h >> np.uint64(29)
    h, owner = h[good], np.cumsum(ends)[:n][good]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    for a, b in zip(cuts, cuts[1:]):
        h[a:b].sort()
    once = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])][: len(h)]
    return h[once], np.bincount(owner[once], minlength=len(texts))


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of all runs of `size` words, one after the other, and their numbers (0 with fewer words)."""
    read, held, long = [], [], 0
    for k, text in enumerate(texts):
        held.append(text or "")
        long += len(held[-1])
        if long >= READ or k + 1 == len(texts):
            read.append(_read(held, size))
            held, long = [], 0
    every, sizes = zip(*read) if read else ([np.empty(0, np.uint64)], [np.empty(0, np.int64)])
    return np.concatenate(every), np.concatenate(sizes)


def _each(texts: list[str | None], size: int) -> list[np.ndarray]:
    every, sizes = shingle_sets(texts, size)
    ends = np.cumsum(sizes)
    return [every[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `size` words; empty when there are fewer words."""
    return shingle_sets([text], size)[0]


def node_of(hashes: np.ndarray) -> int:
    """Identity of a shingle set as a signed 64-bit number."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64)))


def _sketch(size: int, bits: int):
    """Token counts of a partition, as compressed blocks of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint64)
        for batch in batches:
            every, _ = shingle_sets(batch.column(0).to_pylist(), size)
            table += np.bincount((every >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint64)
        if table.any():
            blocks = table.reshape(64, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([zlib.compress(b.tobytes(), 1) for b in blocks], pa.binary())], names=["block", "counts"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = np.frombuffer(zlib.decompress(data), np.uint64)
            total[block] = total[block] + counts if block in total else counts
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in total.values()], pa.binary())], names=["block", "counts"])


def token_counts(texts: DataFrame, size: int, bits: int = SLOT_BITS) -> np.ndarray:
    """The table of counts over all texts; its size is fixed, so it may be sent to the driver and broadcast."""
    kind = "block int, counts binary"
    parts = texts.mapInArrow(_sketch(size, bits), kind)
    out = np.zeros((64, (1 << bits) // 64), np.uint64)
    for r in parts.repartition(16, "block").mapInArrow(_add, kind).toLocalIterator():
        out[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    return out.ravel()


def bitmap(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    out = np.zeros(words, np.uint64)
    bit = hashes % np.uint64(64 * words)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


#: (size above which a set has this finer bitmap as well, its words); the 256 bits of large sets are nearly full.
FINER = ((200, 16), (800, 128))
_NODE = np.dtype([("node", "<i8"), ("size", "<u4"), ("low", "<u4"), ("bits", "<u8", (WORDS,))])


def prefix(size: int, t: float) -> tuple[int, int]:
    """Tokens of a set that are posted, and those of them that are indexed."""
    eps = 1e-9
    return size - int(np.ceil(t * size - eps)) + 1, size - int(np.ceil(2 * t / (1 + t) * size - eps)) + 1


def _pack(size: int, t: float, shared, keys: list[int], most: int = HEAVY):
    """Nodes of a batch with their postings, as one block per part: (key, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, parts = shared.value, len(keys)
        shift = np.uint64(64 - int(len(counts)).bit_length() + 1)
        for batch in batches:
            seen: dict[int, np.ndarray] = {}
            for h in _each(batch.column(0).to_pylist(), size):
                if len(h):
                    seen.setdefault(node_of(h), h)
            if not seen:
                continue
            nodes = np.zeros(len(seen), _NODE)
            sizes = np.fromiter(map(len, seen.values()), np.int64, len(seen))
            every = np.concatenate(list(seen.values()))
            owner = np.repeat(np.arange(len(seen)), sizes)
            nodes["node"], nodes["size"] = list(seen), np.minimum(sizes, 2**32 - 1)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            nodes["low"] = (np.minimum.reduceat(every, starts) * _P1 ^ np.maximum.reduceat(every, starts) * _P2) >> np.uint64(32)
            bit = every % np.uint64(64 * WORDS)
            flat = np.zeros(len(seen) * WORDS, np.uint64)
            np.bitwise_or.at(flat, owner * WORDS + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            nodes["bits"] = flat.reshape(-1, WORDS)
            sets = list(seen.values())
            finer = [{k: bitmap(sets[k], words) for k in np.flatnonzero(sizes > least).tolist()} for least, words in FINER]
            count = counts[(every >> shift).astype(np.int64)]
            order = np.argsort((owner.astype(np.uint64) << np.uint64(40)) | np.minimum(count, np.uint64(2**40 - 1)), kind="stable")  # each set is in order of its hashes
            rank = np.arange(len(every)) - np.repeat(starts, sizes)
            posted, indexed = (np.repeat(np.array(x), sizes) for x in zip(*(prefix(n, t) for n in sizes.tolist())))
            keep = (rank < posted) & (count[order] > 1)  # a token counted once has no partner
            token, count, flag = every[order][keep], count[order][keep], (rank < indexed)[keep]
            owner = owner[keep]
            cells = [(token, owner, flag)]
            if (heavy := count > most).any():  # cell (i, j) of a heavy token: nodes of either block
                cells = [(token[~heavy], owner[~heavy], flag[~heavy])]
                for grid in np.unique(side := -(-count[heavy].astype(np.int64) // most)).tolist():
                    at = np.flatnonzero(heavy)[side == grid]
                    mine = (nodes["node"][owner[at]].view(np.uint64) % np.uint64(grid)).astype(np.int64)
                    for other in range(grid):
                        i, j = np.minimum(mine, other), np.maximum(mine, other)
                        cell = token[at] * _P1 + ((i * grid + j + 1).astype(np.uint64) * _P2)
                        cells.append((cell ^ (cell >> np.uint64(31)), owner[at], flag[at]))
            token, owner, flag = (np.concatenate(x) for x in zip(*cells))
            token = (token >> np.uint64(32)).astype(np.uint32)
            part = (token % np.uint32(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            token, owner, flag, part = token[order], owner[order], flag[order], part[order]
            ends = np.searchsorted(part, np.arange(parts + 1))
            blocks = []
            for k in range(parts):
                a, b = ends[k], ends[k + 1]
                if a < b:
                    used, local = np.unique(owner[a:b], return_inverse=True)
                    posting = (local.astype(np.uint32) << np.uint32(1)) | flag[a:b]
                    blocks.append((keys[k], np.array([len(used), b - a], "<u4").tobytes() + nodes[used].tobytes() + token[a:b].tobytes() + posting.astype("<u4").tobytes() + b"".join(f[k].tobytes() for f in finer for k in used.tolist() if k in f)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int64()), pa.array([d for _, d in blocks], pa.binary())], names=["key", "data"])

    return run


def _ragged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values lo <= v < hi of each row."""
    n = hi - lo
    row = np.repeat(np.arange(len(lo)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _possible(most_a, least_a, all_a, any_a, most_b, least_b, all_b, any_b, t: float) -> np.ndarray:
    """Whether sizes and bitmaps leave room for a pair with similarity t: bits of a that no member of b has cost overlap."""
    overlap = np.minimum(most_a - _bits(all_a & ~any_b), most_b - _bits(all_b & ~any_a))
    return overlap + 1e-9 >= t / (1 + t) * (least_a + least_b)


def _bits(maps: np.ndarray) -> np.ndarray:
    """Set bits of each bitmap."""
    c = np.bitwise_count(maps)
    out = c[:, 0].astype(np.int64)
    for k in range(1, c.shape[1]):
        out += c[:, k]
    return out


class Part:
    """The signature tree of one part."""

    def __init__(self, nodes: np.ndarray, token: np.ndarray, owner: np.ndarray, flag: np.ndarray, finer: list[np.ndarray], t: float):
        self.t = t
        maps = [(np.flatnonzero(nodes["size"] > least), f) for (least, _), f in zip(FINER, finer)]
        _, first, inverse = np.unique(nodes["node"], return_index=True, return_inverse=True)
        nodes, owner = nodes[first], inverse[owner]
        octave = (np.log(nodes["size"]) / np.log(1 / t)).astype(np.int64)
        order = np.lexsort((nodes["size"], octave, nodes["low"]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.nodes, owner, octave = nodes[order], place[owner], octave[order]
        self.finer = []
        for rows, f in maps:
            where, at = np.full(len(order), -1), place[inverse[rows]]
            where[at] = np.arange(len(rows))
            self.finer.append((where, f))
        new = np.r_[True, (np.diff(self.nodes["low"]) != 0) | (np.diff(octave) != 0)]
        at = np.flatnonzero(new)
        step = np.arange(len(new)) - np.repeat(at, np.diff(np.r_[at, len(new)]))
        head = step % 16 == 0
        first = np.flatnonzero(head)
        held = np.diff(np.r_[first, len(head)])
        union = _bits(np.bitwise_or.reduceat(self.nodes["bits"], first))
        mean = np.add.reduceat(_bits(self.nodes["bits"]), first) / held
        head |= np.repeat((union > 1.2 * mean) | (mean > 40 * WORDS), held)  # nodes that differ, or fill their bitmaps, are leaves of their own
        self.first = np.flatnonzero(head)  # of each leaf
        self.last = np.r_[self.first[1:], len(head)]
        leaf = np.cumsum(head) - 1
        size = self.nodes["size"].astype(np.int64)
        self.size, self.bits = size, self.nodes["bits"]
        self.least, self.most = np.minimum.reduceat(size, self.first), np.maximum.reduceat(size, self.first)
        self.any, self.all = np.bitwise_or.reduceat(self.bits, self.first), np.bitwise_and.reduceat(self.bits, self.first)
        key, where = np.unique((token.astype(np.int64) << 32) | leaf[owner], return_inverse=True)
        flags = np.zeros(len(key), bool)
        np.logical_or.at(flags, where, flag)
        self.token, self.leaf, self.flag = key >> 32, key & 0xFFFFFFFF, flags

    def pairs(self) -> np.ndarray:
        """Candidate pairs of nodes as an array of two columns."""
        out = [self._below(np.stack([x := np.flatnonzero(self.last - self.first > 1), x], axis=1))]
        order = np.lexsort((self.least[self.leaf], self.token))
        token, leaf, flag = self.token[order], self.leaf[order], self.flag[order]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
        ends = np.r_[starts[1:], len(token)]
        found = [np.empty(0, np.int64)]
        for s, e in zip(starts[(big := ends - starts > DENSE)].tolist(), ends[big].tolist()):
            found += self._dense(leaf[s:e], flag[s:e])
        small = ~big & (ends - starts > 1)
        lead = np.flatnonzero(flag & np.repeat(small, ends - starts))
        group = np.searchsorted(starts, lead, "right") - 1
        lo, hi = starts[group], ends[group]
        total = np.cumsum(hi - lo)
        cut = 0
        while cut < len(lead):
            to = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + CHUNK, "right")))
            row, j = _ragged(lo[cut:to], hi[cut:to])
            i = lead[cut:to][row]
            good = (i != j) & ~(flag[j] & (j < i))
            found.append(self._allowed(leaf[i[good]], leaf[j[good]]))
            cut = to
        both = np.unique(np.concatenate(found))
        n = len(self.first)
        out.append(self._below(np.stack([both // n, both % n], axis=1)))
        nodes = np.concatenate(out)
        return np.unique(nodes, axis=0) if len(nodes) else nodes

    def _dense(self, leaf: np.ndarray, flag: np.ndarray) -> list[np.ndarray]:
        """Codes of leaf pairs under one token, the common bits counted by a product of bit matrices."""
        other = np.unpackbits(self.any[leaf].view(np.uint8).reshape(len(leaf), -1), axis=1).astype(np.float32).T
        need = (self.t / (1 + self.t) * self.least[leaf]).astype(np.float32)
        lead, out = np.flatnonzero(flag), []
        for k in range(0, len(lead), step := max(1, CHUNK // len(leaf))):
            rows = lead[k : k + step]
            mine = np.unpackbits(self.all[leaf[rows]].view(np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
            room = mine @ other
            room -= (mine.sum(axis=1) - self.most[leaf[rows]].astype(np.float32) + need[rows])[:, None]
            i, j = np.nonzero(room >= need - np.float32(1e-3))
            i = rows[i]
            good = (i != j) & ~(flag[j] & (j < i))
            out.append(self._allowed(leaf[i[good]], leaf[j[good]]))
        return out

    def _allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Codes of the pairs of leaves that sizes and bitmaps allow."""
        good = (self.most[a] >= self.t * self.least[b] - 1e-9) & (self.most[b] >= self.t * self.least[a] - 1e-9)
        a, b = a[good], b[good]
        good = _possible(self.most[a], self.least[a], self.all[a], self.any[a], self.most[b], self.least[b], self.all[b], self.any[b], self.t)
        a, b = a[good], b[good]
        return np.unique(np.minimum(a, b) * len(self.first) + np.maximum(a, b))

    def _below(self, leaves: np.ndarray) -> np.ndarray:
        """Pairs of nodes under pairs of leaves that sizes and bitmaps of the nodes themselves allow."""
        single = (self.last - self.first)[leaves].max(axis=1) == 1  # already held against each other
        x, y = self.first[leaves[single & (leaves[:, 0] != leaves[:, 1])]].T
        out = [self._fine(x, y)]
        leaves = leaves[~single]
        for k in range(0, len(leaves), 1 << 14):
            a, b = leaves[k : k + (1 << 14)].T
            row, x = _ragged(self.first[a], self.last[a])
            again, y = _ragged(self.first[b][row], self.last[b][row])
            x = x[again]
            good = x < y
            x, y = x[good], y[good]
            good = _possible(self.size[x], self.size[x], self.bits[x], self.bits[x], self.size[y], self.size[y], self.bits[y], self.bits[y], self.t)
            good &= np.minimum(self.size[x], self.size[y]) >= self.t * np.maximum(self.size[x], self.size[y]) - 1e-9
            out.append(self._fine(x[good], y[good]))
        return np.concatenate(out)

    def _fine(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs of identities of the nodes at places x and y whose finer bitmaps, where both have them, allow it."""
        for where, maps in self.finer:
            both = np.flatnonzero((where[x] >= 0) & (where[y] >= 0)) if len(maps) else np.empty(0, np.int64)
            good = np.ones(len(x), bool)
            for k in range(0, len(both), 1 << 14):
                at = both[k : k + (1 << 14)]
                a, b = maps[where[x[at]]], maps[where[y[at]]]
                good[at] = _possible(self.size[x[at]], self.size[x[at]], a, a, self.size[y[at]], self.size[y[at]], b, b, self.t)
            x, y = x[good], y[good]
        p, q = self.nodes["node"][x], self.nodes["node"][y]
        return np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1), axis=0)


def _search(t: float):
    def done(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        nodes, tokens, owners, flags, finer, base = [], [], [], [], [[] for _ in FINER], 0
        for data in blocks:
            n, m = np.frombuffer(data, "<u4", 2).tolist()
            nodes.append(np.frombuffer(data, _NODE, n, 8))
            tokens.append(np.frombuffer(data, "<u4", m, 8 + n * _NODE.itemsize))
            posting = np.frombuffer(data, "<u4", m, 8 + n * _NODE.itemsize + 4 * m)
            owners.append((posting >> 1).astype(np.int64) + base)
            flags.append((posting & 1).astype(bool))
            base += n
            at = 8 + n * _NODE.itemsize + 8 * m
            for held, (least, words) in zip(finer, FINER):
                k = int((nodes[-1]["size"] > least).sum())
                held.append(np.frombuffer(data, "<u8", k * words, at).reshape(k, words))
                at += 8 * k * words
        found = Part(*map(np.concatenate, (nodes, tokens, owners, flags)), [np.concatenate(f) for f in finer], t).pairs()
        for k in range(0, len(found), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[k : k + 100_000, 0], pa.int64()), pa.array(found[k : k + 100_000, 1], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks = None, []
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key and blocks:
                    yield from done(blocks)
                    blocks = []
                key = k
                blocks.append(data)
        if blocks:
            yield from done(blocks)

    return run


BLOOM_BITS = 24


def _members(size: int, shared):
    """Node of every text, with its set where the node may have a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, mask = shared.value, (1 << BLOOM_BITS) - 1
        for batch in batches:
            rows = []
            for ident, h in zip(batch.column(0).to_pylist(), _each(batch.column(1).to_pylist(), size)):
                if len(h):
                    node = node_of(h)
                    rows.append((ident, node, h.view(np.int64).tolist() if bloom[(node & mask) >> 3] >> (node & 7) & 1 else None))
            a, b, c = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.list_(pa.int64()))], names=["ident", "node", "tokens"])

    return run


def part_keys(df: DataFrame, parts: int) -> list[int]:
    """Keys that repartition(parts, key) puts into one partition each."""
    spread = df.sparkSession.range(64 * parts).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p")).groupBy("p").agg(F.min("id").alias("id"))
    return [r["id"] for r in spread.orderBy("p").collect()]


def near_copies(texts: DataFrame, *, size: int = 5, threshold: float = 0.8, parts: int | None = None, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """(members, links): the node of every text, and all pairs of nodes with at least the threshold of similarity.

    texts: ident string, text. members: ident, node; texts with the same set of shingles share a node. links: a, b,
    similarity with a < b, between different nodes only. A null or short text without a shingle is no member. Rows
    repeated exactly count once; one ident with different texts has several nodes. Other columns are ignored, an
    empty table gives no rows, and texts are always read whole. The result is exact: no pair is left out.
    """
    spark = texts.sparkSession
    context = spark.sparkContext
    rows = texts.select(F.col("ident").cast("string").alias("ident"), F.col("text").cast("string").alias("text")).where("ident is not null and text is not null")
    table = token_counts(rows.select("text"), size)
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(table.sum()) // TOKENS))
    counts = context.broadcast(table)
    blocks = rows.select("text").mapInArrow(_pack(size, threshold, counts, part_keys(texts, parts), heavy), "key bigint, data binary")
    found = blocks.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_search(threshold), "a bigint, b bigint")
    pairs = written(found.distinct())
    at = F.col("node").bitwiseAND(F.lit((1 << BLOOM_BITS) - 1)) + 1
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).select(at.alias("at"))
    bloom = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    for r in ends.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toLocalIterator():
        bloom[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    every = written(rows.mapInArrow(_members(size, context.broadcast(bloom)), "ident string, node bigint, tokens array<bigint>"))
    sets = every.where("tokens is not null").select("node", "tokens").dropDuplicates(["node"])
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    links = both.select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
    return every.select("ident", "node").distinct(), written(links)


def pairs_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of texts (a < b) behind links and common nodes, for results that must list them."""
    left, right = members.select(F.col("ident").alias("p"), F.col("node").alias("a")), members.select(F.col("ident").alias("q"), F.col("node").alias("b"))
    across = links.select("a", "b").join(left, "a").join(right, "b").select("p", "q")
    within = left.join(right, F.col("a") == F.col("b")).where("p < q").select("p", "q")
    return across.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).unionByName(within.select(F.col("p").alias("a"), F.col("q").alias("b"))).distinct()


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """ident, class, links: the class of a text is the least node it is linked to directly or through others.

    Alternating rounds of taking the least neighbour and jumping to its label; a chain of n links needs about
    log n rounds. `links` counts the other nodes a text's node is linked to.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = edges.join(label.select(F.col("a").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = label.join(near, "a").select("a", F.least("label", "other").alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("a").alias("label"), F.col("label").alias("further"))
        new = written(step.join(jump, "label", "left").select("a", F.least("label", F.coalesce("further", "label")).alias("label"), "old"))
        if new.where("label <> old").isEmpty():
            break
        label = new.select("a", "label")
    degree = edges.groupBy("a").agg(F.count("*").alias("links"))
    labels = new.select(F.col("a").alias("node"), "label").join(degree.withColumnRenamed("a", "node"), "node")
    out = members.join(labels, "node", "left")
    return out.select("ident", F.coalesce("label", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
