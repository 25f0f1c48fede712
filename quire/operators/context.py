"""Passages for a prompt: numbering, order by part, budgets, and short forms of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that make a passage fit a part, and the text that stands for no passage.
PART_WORDS = {
    "concept": "definition|define|theorem|정의|정리|introduction|continuous|increasing|decreasing|property".split("|"),
    "examples": "example|sample|solution|예제|예 |worked".split("|"),
    "practice": "exercise|problem|practice|연습|문제|#7|#24".split("|"),
}
NO_SOURCE = "SOURCE: (NO-SOURCE — no reference chunks were supplied; no study context has been loaded for this question)"


def occurrences(text: Column, part: str) -> Column:
    """How often a string is in a text, without overlaps."""
    t = F.coalesce(text, F.lit(""))
    return ((F.length(t) - F.length(F.replace(t, F.lit(part)))) / len(part)).cast("int")


def marker_count(text: Column, marker: str) -> Column:
    """Marks followed by a blank."""
    return occurrences(text, marker + " ")


def part_score(text: Column, part: str) -> Column:
    """Uses of the words of a part in a passage."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((occurrences(low, w) for w in PART_WORDS.get(part, ())), F.lit(0))


def part_order(passages: DataFrame, group: str, order: str, text: str, part: str) -> DataFrame:
    """passages with `place`: the leading fifth of a group (two at least) first, then the others by the part's words."""
    within = Window.partitionBy(group)
    rows = passages.withColumns({"rank__": F.row_number().over(within.orderBy(order)), "all__": F.count("*").over(within), "score__": part_score(F.col(text), part)})
    lead = F.col("rank__") <= F.greatest(F.lit(1), F.least(F.col("all__"), F.greatest(F.lit(2), F.floor(F.col("all__") / 5))))
    by = within.orderBy(F.desc("lead__"), F.when(F.col("lead__"), F.col("rank__")), F.desc("score__"), "rank__")
    return rows.withColumn("lead__", lead).withColumn("place", F.row_number().over(by)).drop("rank__", "all__", "score__", "lead__")


def numbered(passages: Column, label: Column | None = None) -> Column:
    """Passages of an array as '[1] ...' blocks below an optional heading; blank ones keep their number only."""
    parts = F.transform(F.coalesce(passages, F.array().cast("array<string>")), lambda x, i: F.trim(F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(x, F.lit("")))))
    if label is not None:
        parts = F.concat(F.when(F.coalesce(label, F.lit("")) != "", F.array(F.concat(F.lit("## "), label))).otherwise(F.array().cast("array<string>")), parts)
    return F.array_join(parts, "\n\n")


def context_block(sources: Column, most: int = 6000) -> Column:
    """One text from an array of (source, section, text): whole passages until one would pass the limit.

    What counts as used is the text with its source and section; the next text alone is held against the rest.
    """

    def step(acc, x):
        text, name, section = F.trim(x["text"]), F.coalesce(x["source"], F.lit("")), F.coalesce(x["section"], F.lit(""))
        fits = ~acc["full"] & (acc["used"] + F.length(text) <= most)
        part = F.concat(F.lit("SOURCE ["), name, F.lit("] ("), F.when(section == "", F.lit("sec?")).otherwise(section), F.lit("):\n"), text)
        return F.struct(
            F.when(fits, acc["used"] + F.length(text) + F.length(name) + F.length(section)).otherwise(acc["used"]).alias("used"),
            (~fits).alias("full"),
            F.when(fits, F.concat(acc["out"], F.array(part))).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("out"))
    rows = F.filter(F.coalesce(sources, F.array()), lambda x: x["text"].isNotNull())
    return F.when(F.size(rows) == 0, F.lit(NO_SOURCE)).otherwise(F.array_join(F.aggregate(rows, zero, step, lambda acc: acc["out"]), "\n\n---\n\n"))


def front_matter(**fields: Column) -> Column:
    """A block of 'name: value' lines between rules; null fields are left out."""
    lines = [F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def without_front_matter(text: Column) -> Column:
    """What follows the last rule of a part file."""
    parts = F.split(F.coalesce(text, F.lit("")), "---\n\n")
    return F.element_at(parts, -1)


def badge(source: Column, section: Column) -> Column:
    """'[source · section]', without the dot where there is no section."""
    return F.concat(F.lit("["), F.concat_ws(" · ", source, F.nullif(section, F.lit(""))), F.lit("]"))


def messages(system: Column, user: Column) -> Column:
    """Messages of a conversation, the system's first; a null one is left out."""
    rows = [F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user))]
    return F.filter(F.array(*rows), lambda m: m["content"].isNotNull())


def without_leading_headings(text: Column, marker: str) -> Column:
    """A list without headings before its first marker line."""
    lines = F.split(F.trim(F.coalesce(text, F.lit(""))), "\n")
    stop = F.coalesce(F.array_position(F.transform(lines, lambda x: ~F.startswith(F.ltrim(x), F.lit("#")) | F.startswith(F.ltrim(x), F.lit(marker))), True), F.lit(0))
    return F.when(stop > 0, F.trim(F.array_join(F.slice(lines, stop.cast("int"), F.size(lines)), "\n"))).otherwise(F.lit(""))


def token_cap(wanted: Column, most: int, least: int = 256) -> Column:
    """A budget within its bounds; null asks for the most."""
    return F.greatest(F.lit(least), F.least(F.coalesce(wanted, F.lit(most)), F.lit(most)))
