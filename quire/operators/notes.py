"""Notes made of validated payloads, with their figures and problem banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import dotted_numbers

# Order of the parts of a note, their headings and labels, sizes of a bank.
CORE_ORDER = {"exam": ("lecture", "cs", "r", "as", "ex", "pr"), "note": ("lecture", "cs", "r", "as"), "problems": ("pr",)}
LABELS = {
    "th": "Theorems", "prf": "Proofs", "cd": "Conditions", "cx": "Counterexamples", "law": "Laws", "var": "Key quantities", "case": "Important cases",
    "setup": "Setup", "sign": "Sign conventions", "eq": "Key equations", "cond": "Reaction conditions", "mech": "Mechanism", "spec": "Species", "trend": "Trends",
    "ox": "Oxidation states", "path": "Pathways", "cmp": "Comparisons", "cyc": "Cycles", "tree": "Relationships", "org": "Structures", "exp": "Experimental design",
}
SUBJECT_KEYS = {
    "math": ("th", "prf", "cd", "cx"), "phys": ("law", "var", "case", "setup", "sign"),
    "chem": ("eq", "cond", "mech", "spec", "trend", "ox"), "bio": ("path", "cmp", "cyc", "tree", "org", "exp"),
}
BANK = {"basic": 10, "intermediate": 5, "advanced": 5}
MARK = "## Problem Bank"

_ITEM = "struct<c:string,d:string,f:string,k:string,m:string,src:string,p:string,s:string,lvl:string>"


def allowed_keys(subject: Column, kind: Column) -> Column:
    """Keys a payload of a subject and kind may have."""
    none = F.array().cast("array<string>")
    core, packs = none, none
    for k, keys in CORE_ORDER.items():
        core = F.when(kind == k, F.array(*map(F.lit, keys))).otherwise(core)
    for s, keys in SUBJECT_KEYS.items():
        packs = F.when(subject == s, F.array(*map(F.lit, keys))).otherwise(packs)
    return F.concat(core, packs)


def unknown_keys(payload: Column, subject: Column, kind: Column) -> Column:
    """Keys of a JSON payload that its subject and kind do not allow, in order."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), allowed_keys(subject, kind)))


def patches(issues: DataFrame) -> DataFrame:
    """id and the slots that have to be made again, from the issues of payloads."""
    return issues.where("slot <> ''").groupBy("id").agg(F.array_sort(F.collect_set("slot")).alias("slots"))


def first_issues(issues: DataFrame, most: int = 8) -> DataFrame:
    """The first messages of each payload, which are asked to be mended at once; a payload has few slots, so few issues."""
    return issues.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("message")), 1, most).alias("messages"))


def ceilings(rules: DataFrame) -> DataFrame:
    """kind and the most tokens its slots may take: items times their budget, that of their fields, or 100."""
    slots = rules.groupBy("kind", "slot").agg(F.max("type").alias("type"), F.max("max").alias("max"), F.max("budget").alias("budget"), F.sum("field_budget").alias("fields"))
    item = F.coalesce(F.nullif("budget", F.lit(0)), F.when(F.col("type") == "array", F.nullif("fields", F.lit(0))), F.lit(100))
    return slots.groupBy("kind").agg(F.sum(item * F.when(F.col("type") == "array", F.coalesce(F.nullif("max", F.lit(0)), F.lit(1))).otherwise(1)).cast("bigint").alias("ceiling"))


def _text(payload: Column, key: str) -> Column:
    return F.get_json_object(payload, f"$.{key}")


def _lines(values: Column, mark) -> Column:
    return F.array_join(F.filter(F.transform(values, mark), lambda x: x.isNotNull()), "\n")


def _under(heading: str, body: Column) -> Column:
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {heading}\n\n"), body))


def _core(payload: Column, key: str) -> Column:
    raw = _text(payload, key)
    listed = raw.rlike(r"^\s*\[")
    texts, items = F.from_json(raw, "array<string>"), F.from_json(raw, f"array<{_ITEM}>")
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    if key in ("lecture", "r"):
        return F.when(~listed, _under({"lecture": "Reading the Topic", "r": "Worked recipe"}[key], raw))
    if key == "as":
        return F.when(listed, _under("Applications", _lines(texts, lambda x: F.when(some(x), F.concat(F.lit("- "), x)))))
    if key == "cs":
        named = (("d", "Definition"), ("f", "Formula"), ("k", "Intuition"), ("m", "Common mistake"))
        concept = lambda x: F.concat(F.rtrim(F.concat(F.lit("### "), F.coalesce(x["c"], F.lit("")))), *(F.when(some(x[k]), F.concat(F.lit(f"\n\n**{n}.** "), x[k])).otherwise(F.lit("")) for k, n in named))
        return F.when(listed, _under("Concepts", F.array_join(F.transform(items, concept), "\n\n")))
    solved = lambda x: F.concat(F.coalesce(x["p"], F.lit("")), F.when(some(x["src"]), F.concat(F.lit("\n\n> 출처: "), F.trim(x["src"]))).otherwise(F.lit("")), F.lit("\n\n**Solution.** "), F.coalesce(x["s"], F.lit("")))
    if key == "ex":
        return F.when(listed, _under("Worked examples", F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("### Worked example "), (i + 1).cast("string"), F.lit("\n\n"), solved(x))), "\n\n")))
    level = lambda x: F.when(x["lvl"] == "b", F.lit("Basic ")).when(x["lvl"] == "a", F.lit("Advanced ")).otherwise(F.lit(""))
    problems = F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("### "), level(x), F.lit("Problem "), (i + 1).cast("string"), F.lit("\n\n"), F.coalesce(x["p"], F.lit("")), F.lit("\n\n**Solution.** "), F.coalesce(x["s"], F.lit("")))), "\n\n")
    plain = F.array_join(F.filter(F.transform(texts, lambda x, i: F.when(some(x), F.concat((i + 1).cast("string"), F.lit(". "), x))), lambda x: x.isNotNull()), "\n")
    return F.when(listed & raw.rlike(r"^\s*\[\s*\{"), _under("Problems", problems)).when(listed, _under("Practice problems", plain))


def rendered(payload: Column, meta: dict[str, Column], kind: Column) -> Column:
    """A note from a JSON payload: front matter from meta (title, subject, kind, book, section, source; null ones left out), the parts of its kind, then labelled ones."""
    head = F.concat(F.lit("---\n"), F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v) for k, v in meta.items())), F.lit("\n---\n\n# "), F.coalesce(meta["title"], F.lit("")), F.lit("\n"))
    parts = [F.when(kind.isin([k for k, keys in CORE_ORDER.items() if key in keys]), _core(payload, key)) for key in CORE_ORDER["exam"]]
    for key, label in LABELS.items():
        raw = _text(payload, key)
        items = _lines(F.from_json(raw, "array<string>"), lambda x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit("- "), x)))
        parts.append(F.when(raw.rlike(r"^\s*\["), _under(label, items)).otherwise(_under(label, raw)))
    return F.concat(head, F.lit("\n"), F.concat_ws("\n", *parts), F.lit("\n"))


def figures_of(topics: DataFrame, figures: DataFrame) -> DataFrame:
    """topic_id with the figures of its book whose section holds one of the topic's numbers, as whole numbers.

    topics: topic_id, book_id, section ('3.5, 3.6'). figures: fig_id, book_id, section and more.
    """
    asked = F.filter(F.transform(F.split(F.coalesce("section", F.lit("")), "[,;]"), F.trim), lambda x: x != "")
    wanted = topics.select("topic_id", "book_id", F.explode(F.array_distinct(asked)).alias("number__"))
    have = figures.withColumn("number__", F.explode(F.array_distinct(dotted_numbers(F.col("section")))))
    return wanted.join(have, ["book_id", "number__"]).drop("number__").dropDuplicates(["topic_id", "fig_id"])


def new_figures(registered: DataFrame, parsed: DataFrame) -> DataFrame:
    """registered figures with those parsed whose id is new; a null id is that of the book and the place ('at'); of several of one id the first."""
    rows = parsed.withColumn("fig_id", F.coalesce("fig_id", F.concat("book_id", F.lit("-"), F.col("at").cast("string"))))
    first = Window.partitionBy("fig_id").orderBy("at", "book_id")
    rows = rows.withColumn("rank__", F.row_number().over(first)).where("rank__ = 1").drop("rank__", "at")
    return registered.unionByName(rows.join(registered.select("fig_id"), "fig_id", "left_anti").select(registered.columns))


def with_figures(note: Column, figures: Column) -> Column:
    """A note with a figure section at its end, from an array of (fig_id, book_id, path, caption, page); one that has it stays as it is."""

    def shown(x, i):
        n, caption = (i + 1).cast("string"), F.coalesce(x["caption"], F.lit(""))
        source = F.when(x["page"].isNotNull(), F.concat(F.lit("\n*(source: "), x["book_id"], F.lit(", p."), x["page"].cast("string"), F.lit(")*"))).otherwise(F.lit(""))
        alt = F.when(caption == "", x["fig_id"]).otherwise(caption)
        return F.concat(F.lit("!["), alt, F.lit("]("), x["path"], F.lit(")\n*Figure "), n, F.lit("."), F.when(caption == "", F.lit("")).otherwise(F.concat(F.lit(" "), caption)), F.lit("*"), source)

    body = F.array_join(F.transform(figures, shown), "\n\n")
    stays = figures.isNull() | (F.size(figures) == 0) | F.contains(note, F.lit("\n## Figures"))
    return F.when(stays, note).otherwise(F.concat(F.regexp_replace(note, r"\n+\z", ""), F.lit("\n\n## Figures\n\n"), body, F.lit("\n")))


def bank_counts(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, level, n: numbered items below each ### or #### heading; levels by name, other headings by their text.

    A fold over the lines of each row, so nothing is shuffled but the counts of one text.
    """
    zero = F.expr("named_struct('level', cast(null as string), 'found', cast(array() as array<string>))")

    def step(acc, line):
        head = F.lower(F.trim(F.regexp_extract(line, r"^#{3,4}\s+(.+)$", 1)))
        level = F.when(head.rlike("basic|기초|기본"), F.lit("basic")).when(head.rlike("intermediate|중급"), F.lit("intermediate")).when(head.rlike("advanced|고급"), F.lit("advanced")).otherwise(head)
        item = acc["level"].isNotNull() & F.trim(line).rlike(r"^\d+[.)]\s")
        mark = F.when(head != "", F.array(F.concat(level, F.lit("\t0")))).when(item, F.array(F.concat(acc["level"], F.lit("\t1")))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.when(head != "", level).otherwise(acc["level"]).alias("level"), F.concat(acc["found"], mark).alias("found"))

    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n"), lambda x: x.rlike(r"^\s*(?:#{3,4}\s|\d+[.)]\s)"))
    rows = docs.select(F.col(ident).alias("ident"), F.explode(F.aggregate(lines, zero, step, lambda acc: acc["found"])).alias("f"))
    return rows.groupBy("ident", F.substring_index("f", "\t", 1).alias("level")).agg(F.sum(F.substring_index("f", "\t", -1).cast("int")).alias("n"))


def bank_verdicts(counts: DataFrame) -> DataFrame:
    """ident and what is wrong with the counts of its bank: the first level with another number than asked, '' for none."""
    held = counts.groupBy("ident").agg(*(F.coalesce(F.sum(F.when(F.col("level") == k, F.col("n"))), F.lit(0)).alias(k) for k in BANK))
    said = F.coalesce(*(F.when(F.col(k) != n, F.format_string(f"{k}: got %d, want {n}", F.col(k))) for k, n in BANK.items()), F.lit(""))
    return held.select("ident", said.alias("issue"))


def without_bank(note: Column) -> Column:
    """A note without its problem bank."""
    return F.when(F.contains(note, F.lit(MARK)), F.concat(F.regexp_replace(F.substring_index(note, MARK, 1), r"\s+\z", ""), F.lit("\n"))).otherwise(note)


def with_bank(note: Column, bank: Column) -> Column:
    """A note with the bank at its end, in place of the one it may have."""
    base = F.when(F.contains(note, F.lit(MARK)), without_bank(note)).otherwise(F.regexp_replace(note, r"\s+\z", ""))
    return F.concat(base, F.lit("\n\n"), F.regexp_replace(bank, r"^\s+|\s+\z", ""), F.lit("\n"))
