"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mixed_tokens(text: Column) -> Column:
    """ceil(ascii / 4) + other characters, at least 1; null counts as the empty text."""
    t = F.coalesce(text, F.lit(""))
    other = F.when(F.octet_length(t) == F.length(t), F.lit(0)).otherwise(F.length(F.regexp_replace(t, r"[\x00-\x7F]+", "")))
    return F.greatest(F.lit(1), (F.floor((F.length(t) - other + 3) / 4) + other).cast("int"))


def third_tokens(text: Column) -> Column:
    """(characters + 2) div 3, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.length(F.coalesce(text, F.lit(""))) + 2) / 3).cast("int"))


def words(text: Column) -> Column:
    """Lower-cased runs of Latin letters, digits and Hangul, with repeats, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([0-9a-z가-힣]+)"), 1)


def slug(text: Column) -> Column:
    """Lower-case identifier: other characters than a-z, 0-9 and Hangul become one hyphen; empty gives 'untitled'."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9가-힣]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def file_slug(text: Column) -> Column:
    """File-name form of a text: keeps case and `_ . -`; empty gives 'range'."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9A-Za-z가-힣_.-]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("range")).otherwise(s)


def dotted_numbers(text: Column) -> Column:
    """All dotted numbers such as 3.5 or 3.5.1 of a heading, as whole tokens."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+(?:\.[0-9]+)+)"), 1)


def first_number(text: Column) -> Column:
    """First dotted number of a heading, null when there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"([0-9]+(?:\.[0-9]+)+)", 1)
    return F.nullif(found, F.lit(""))
