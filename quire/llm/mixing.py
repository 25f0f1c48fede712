"""Mixing sources to target shares of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import written

BUCKETS = 64
#: Longest remainder, in tokens, that is left to the exact subset-sum step.
REACH = 1 << 17
#: Items of the subset-sum step between two kept states.
BLOCK = 256


def source_name(source: Column) -> Column:
    """One spelling of a source: trimmed, lower case, blanks and underscores as hyphens; blank counts as null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "-"), F.lit(""))


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum is as close to, but not above, the budget as possible.

    Takes the same fraction of every length first, then of the rest the longest that fit until the remainder
    is at most REACH, and solves that exactly as a bounded knapsack over a bit set of reachable sums.
    """
    order = np.argsort(-lengths)
    n, c = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((n * c).sum())
    if budget >= total:
        taken = c.copy()
    else:
        keep = min(REACH // 2, budget // 16 + 4 * (total // int(c.sum())))
        share = max(0, budget - keep) / total
        taken = np.diff(np.floor(np.cumsum(c * share)).astype(np.int64), prepend=0)  # rounding errors carry on to the next length
        while int((n * taken).sum()) > budget:
            taken[np.flatnonzero(taken)[0]] -= 1
        rest = budget - int((n * taken).sum())
        for k in range(len(n)):
            if rest <= REACH:
                break
            more = min(int(c[k] - taken[k]), (rest - REACH) // int(n[k]) + 1, rest // int(n[k]))
            taken[k] += more
            rest -= more * int(n[k])
        taken += _knapsack(n, c - taken, rest)
    out = np.zeros(len(lengths), np.int64)
    out[order] = taken
    return out


def _knapsack(n: np.ndarray, c: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: counts in powers of two, sums as bits of one integer, traced back from the best.

    Every BLOCK items the state is kept; the trace computes the states in between again, block by block.
    """
    taken = np.zeros(len(n), np.int64)
    if budget <= 0:
        return taken
    mask, reach, items, kept = (1 << (budget + 1)) - 1, 1, [], [1]
    for k in range(len(n)):
        left, size = min(int(c[k]), budget // int(n[k])), 1
        while left > 0:
            take = min(size, left)
            new = (reach | (reach << (take * int(n[k])))) & mask
            if new != reach:
                items.append((k, take))
                reach = new
                if len(items) % BLOCK == 0:
                    kept.append(reach)
            left -= take
            size *= 2
        if reach >> budget & 1:  # the sum is met
            break
    at = reach.bit_length() - 1
    for start in reversed(range(0, len(items), BLOCK)):
        before, states = kept[start // BLOCK], []
        for k, take in items[start : start + BLOCK]:
            states.append((k, take, before))
            before = (before | (before << (take * int(n[k])))) & mask
        for k, take, before in reversed(states):
            if not before >> at & 1:
                taken[k] += take
                at -= take * int(n[k])
    return taken


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rounds over all texts of a source, and how many of each length once more."""
    pdf = pdf.sort_values("tokens")
    lengths, counts = pdf["tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    budget, most = int(pdf["budget"].iloc[0]), int(pdf["max_repeats"].iloc[0])
    total = int((lengths * counts).sum())
    rounds = min(most, budget // total)
    extra = fill(lengths, counts, budget - rounds * total) if rounds < most else np.zeros(len(lengths), np.int64)
    return pd.DataFrame({"source": pdf["source"], "tokens": lengths, "rounds": rounds, "extra": extra})


def mix(docs: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) of a mixture in which each source holds its target share of all tokens.

    docs: ident, source, text_key (equal for equal texts), tokens. targets: source, target_share, max_repeats.
    chosen: ident, source, tokens, copies (1 to max_repeats). shares: source, target_share, max_repeats,
    budget, available, tokens, share; a target without texts has 0 tokens.

    total_tokens: size of the mixture; by default the greatest at which every source that has texts can hold
    its part with at most max_repeats copies of a text, the shares being taken relative to the sources that
    have texts. With a greater size a short source gives all it may and its share falls below its target.

    A text counts once however many rows hold it (the row with the smallest ident, and that row's source), so
    no text passes the cap through its copies. Rows with a null source, one without target, null ident or no
    tokens are never chosen. Which texts of a length are taken is decided by a seeded hash of the ident, so
    it does not change between runs. Empty tables give an empty mixture.

    The histogram per source and length is the only thing a task holds; texts are chosen through hash buckets
    of each (source, length), so no window gathers all texts of a hot source.
    """
    keys = docs.where("ident is not null and source is not null and tokens > 0").select("ident", "source", "text_key", "tokens")
    wanted = targets.where("source is not null").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    once = keys.groupBy("text_key").agg(F.min(F.struct("ident", "source", "tokens")).alias("r")).select("r.*")
    once = written(once.join(wanted.where("target_share > 0 and max_repeats > 0").select("source"), "source", "left_semi"))
    lengths = once.groupBy("source", "tokens").agg(F.count("*").alias("n"))
    have = lengths.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("available"))
    known = wanted.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    everyone = Window.partitionBy()
    if total_tokens is None:  # a window over one row per target
        share = F.col("target_share") / F.sum(F.when(F.col("available") > 0, F.col("target_share"))).over(everyone)
        cap = F.min(F.when(F.col("available") > 0, F.col("available") * F.col("max_repeats") / share)).over(everyone)
        known = known.withColumn("budget", F.when(F.col("available") > 0, F.floor(share * cap)).otherwise(F.lit(0)))
    else:
        known = known.withColumn("budget", F.floor(F.col("target_share") * F.lit(total_tokens)))
    known = written(known.withColumn("budget", F.coalesce(F.least("budget", F.col("available") * F.col("max_repeats")), F.lit(0)).cast("bigint")))
    plan = lengths.join(known.where("available > 0").select("source", "budget", "max_repeats"), "source").groupBy("source").applyInPandas(_plan, "source string, tokens bigint, rounds bigint, extra bigint")
    plan = written(plan)

    draw = F.xxhash64(F.lit(seed), "ident")
    drawn = once.select("ident", "source", "tokens", draw.alias("draw"), F.pmod(F.shiftright(draw, 40), F.lit(BUCKETS)).alias("bucket"))
    group = ["source", "tokens", "bucket"]
    before = drawn.groupBy(*group).agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("source", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.join(plan, ["source", "tokens"]).select(*group, F.coalesce("before", F.lit(0)).alias("before"), "rounds", "extra")
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("draw", "ident"))).join(before, group)
    copies = F.col("rounds") + (F.col("before") + F.col("rank") <= F.col("extra")).cast("bigint")
    chosen = ranked.select("ident", "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")
    reached = plan.join(lengths, ["source", "tokens"]).groupBy("source").agg(F.sum(F.col("tokens") * (F.col("n") * F.col("rounds") + F.col("extra"))).alias("tokens"))
    shares = known.join(reached, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    shares = shares.withColumn("share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(everyone), F.lit(0)), F.lit(0.0)))
    return chosen, shares.select("source", "target_share", "max_repeats", "budget", "available", "tokens", "share")
