"""The N best items of every group by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, groups: list[str], item: str, score: str, n: int, *, salts: int = 32) -> DataFrame:
    """Columns `groups`, place (from 1), `item`, `score`: the n items with the highest score of each group.

    Only finite scores count; null, NaN and infinite ones never rank. An item given several times counts once
    with its best score, a null item not at all; equal scores rank by smaller item. Null is a group value like
    any other. Other columns are ignored. An empty table, or n < 1, gives an empty result.

    Each group is hashed into `salts` subgroups; the first ranking keeps n of each subgroup, the second ranks
    the at most n * salts survivors of a group. Both rankings are pruned before their shuffle
    (WindowGroupLimit), so a group with a third of all rows is ranked by `salts` tasks.
    """
    keys = [f"g{k}" for k in range(len(groups))]
    s = F.col(f"`{score}`").cast("double")
    rows = df.select(*(F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys)), F.col(f"`{item}`").alias("item"), s.alias("score"))
    rows = rows.where("item is not null and score > double('-Infinity') and score < double('Infinity') and not isnan(score)")
    best = rows.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts))).groupBy(*keys, "salt", "item").agg(F.max("score").alias("score"))
    by = (F.col("score").desc(), F.col("item").asc())
    first = best.withColumn("near", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*by))).where(F.col("near") <= n)
    last = first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("place") <= n)
    return last.select(*(F.col(k).alias(g) for k, g in zip(keys, groups)), "place", F.col("item").alias(item), F.col("score").alias(score))
