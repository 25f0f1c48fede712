"""JSON payloads of generated answers: finding, validating and counting them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions.text import mixed_tokens


_OUTSIDE, _INSIDE = re.compile(r'[{}"]'), re.compile(r'\\.|"', re.DOTALL)


def _last_object(text: str | None) -> str | None:
    """The last balanced object in noisy text that is JSON; braces in strings do not count."""
    text, best, depth, start, at = text or "", None, 0, 0, 0
    while m := _OUTSIDE.search(text, at):
        c, at = m.group(), m.end()
        if c == '"':
            while depth and (q := _INSIDE.search(text, at)):  # to the end of the string
                at = q.end()
                if q.group() == '"':
                    break
        elif c == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                try:
                    best = text[start:at] if isinstance(json.loads(text[start:at]), dict) else best
                except ValueError:
                    pass
    return best


@F.pandas_udf(StringType())
def last_object(text: pd.Series) -> pd.Series:
    return text.map(_last_object)


def strict_json(text: Column) -> Column:
    """The text without a code fence where it is valid JSON, else null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    return F.when(F.try_parse_json(bare).isNotNull(), bare)


def issues(payloads: DataFrame, rules: DataFrame) -> DataFrame:
    """id, slot, message of everything in a payload that breaks the rules of its kind.

    payloads: id, kind, payload (JSON object). rules: kind, slot, type ('string' or 'array'), max (items), budget
    (tokens), field, field_budget, one row per field of an array slot, field null where there is none. No slot is
    required. A payload that is no object gives one issue with slot ''.
    """
    rows = payloads.select("id", "kind", F.from_json("payload", "map<string,string>").alias("m"), F.col("payload").rlike(r"^\s*\{").alias("object"))
    broken = rows.where("not coalesce(object, false) or m is null").select("id", F.lit("").alias("slot"), F.lit("not an object").alias("message"))
    slots = rows.where("object").select("id", "kind", F.explode("m").alias("slot", "value"))
    top = rules.groupBy("kind", "slot").agg(F.max("type").alias("type"), F.max("max").alias("max"), F.max("budget").alias("budget"))
    held = slots.join(top, ["kind", "slot"], "left").withColumn("list", F.from_json("value", "array<string>"))
    blank = (F.coalesce(F.trim("value"), F.lit("")) == "") | F.col("value").isin("[]", "null")
    array = F.col("type") == "array"
    message = (
        F.when(F.col("type").isNull(), F.lit("unknown key"))
        .when(blank, F.lit("empty"))
        .when(array & ~F.col("value").rlike(r"^\s*\["), F.lit("must be an array"))
        .when(~array & F.col("value").rlike(r"^\s*[\[{]"), F.lit("must be a string"))
        .when(array & (F.size("list") > F.col("max")), F.concat(F.lit("more than "), F.col("max").cast("string"), F.lit(" items")))
        .when(~array & (mixed_tokens(F.col("value")) > F.col("budget")), F.concat(F.lit("exceeds budget "), F.col("budget").cast("string")))
    )
    whole = held.select("id", "slot", message.alias("message")).where("message is not null")
    items = held.where(array & F.col("value").rlike(r"^\s*\[")).select("id", "kind", "slot", F.posexplode("list").alias("at", "item"))
    fields = items.select("id", "kind", "slot", "at", F.explode(F.from_json("item", "map<string,string>")).alias("field", "value"))
    known = rules.where("field is not null").select("kind", "slot", "field", "field_budget", F.lit(True).alias("known"))
    shaped = fields.join(known.select("kind", "slot").distinct(), ["kind", "slot"], "left_semi").join(known, ["kind", "slot", "field"], "left")
    said = F.when(F.col("known").isNull(), F.lit("unknown field")).when(mixed_tokens(F.col("value")) > F.col("field_budget"), F.concat(F.lit("exceeds budget "), F.col("field_budget").cast("string")))
    place = F.concat("slot", F.lit("["), F.col("at").cast("string"), F.lit("]."), "field")
    inner = shaped.select("id", "slot", F.concat(place, F.lit(": "), said).alias("message")).where("message is not null")
    return broken.unionByName(whole).unionByName(inner)


def usage_totals(rows: DataFrame, group: str, usage: str) -> DataFrame:
    """Token counts per group from JSON usage records; missing counts are 0."""
    u = F.from_json(usage, "prompt bigint, completion bigint, cache_hit bigint, cache_miss bigint")
    return rows.select(group, u.alias("u")).groupBy(group).agg(*(F.sum(F.coalesce(F.col(f"u.{k}"), F.lit(0))).alias(k) for k in ("prompt", "completion", "cache_hit", "cache_miss")))
