"""Plans, gates and budgets over generated answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles by action, and words that decide an action, first match wins; matched as substrings.
ROLES = {"explain": "worker", "summary": "worker", "search": "worker", "proof": "reasoner", "derive": "reasoner", "deep": "reasoner", "code": "coder", "fix": "coder", "review": "coder"}
HEADING_RULES = (
    ("problems|problem set|exercise|exercises|practice|make problems|문제|출제|generate problems|worksheet", "problems", "worker"),
    ("fix|bug|bugfix|patch|error", "fix", "coder"),
    ("code|implement|implementing|refactor|write code", "code", "coder"),
    ("review|optimize", "review", "coder"),
    ("proof|prove|derive|deriving|rigor|rigorous|deep dive", "proof", "reasoner"),
    ("explain|concept|quote|intuition|summar|summarize|why|when|describe|state", "explain", "worker"),
)
BODY_RULES = (
    ("problems|exercise|practice|worksheet|make up a|create a problem", "problems", "worker"),
    ("proof|prove|derive|derivation|rigor", "proof", "reasoner"),
    ("deep dive|verify", "deep", "reasoner"),
    ("fix|bug|bugfix|patch|indexerror", "fix", "coder"),
    ("implement|refactor", "code", "coder"),
    ("search|find|locate|similar", "search", "worker"),
    ("summar", "summary", "worker"),
    ("explain|concept|why is|intuition", "explain", "worker"),
)
# Words of a line that states an outcome, of a question that asks for a number, of an answer that says there is none.
OUTCOME = r"(?i)(terms|need|require|required|approx|about|more than|at least|at most|equals?|is about|=|within|cannot|can't|not covered)"

INTENT = r"(?i)(how many|terms|approxim|within|find\s+n|value of|what|equals?|should be|error|to within)"
ABSENT = "not covered|not present|no source|cannot say"


def classify(heading: Column, body: Column) -> tuple[Column, Column]:
    """Action and role of a task: by its heading, else by its body, else explain."""
    action, role = F.lit("explain"), F.lit("worker")
    for text, rules in ((body, BODY_RULES), (heading, HEADING_RULES)):
        low = F.lower(F.coalesce(text, F.lit("")))
        for words, a, r in reversed(rules):
            action, role = F.when(low.rlike(words), F.lit(a)).otherwise(action), F.when(low.rlike(words), F.lit(r)).otherwise(role)
    return action, role


def default_role(action: Column) -> Column:
    """The role of an action by the fixed table; an unknown action is the worker's."""
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(action))), F.lit("worker"))


def split_plans(plans: DataFrame) -> DataFrame:
    """plan_id, id, heading, input, target, action, role: the tasks of each plan (plan_id, plan).

    Tasks begin at [Task ...] marks, without any at '## Task' lines; a plan with neither has no task.
    """
    marks = r"(?i)\[Task[^\]]*\]"
    body = F.trim(F.coalesce("plan", F.lit("")))
    pattern = F.when(body.rlike(marks), F.lit(marks)).otherwise(F.lit(r"(?m)^##\s+Task\b"))
    rows = plans.select("plan_id", body.alias("body"), pattern.alias("p"))
    rows = rows.select("plan_id", F.regexp_extract_all("body", F.col("p"), 0).alias("heads"), F.slice(F.split("body", F.col("p")), 2, 1_000_000).alias("parts"))
    rows = rows.select("plan_id", F.posexplode(F.arrays_zip("heads", "parts")).alias("pos", "t"))
    tidy = F.array_join(F.filter(F.transform(F.split(F.col("t.parts"), "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    rows = rows.select("plan_id", (F.col("pos") + 1).alias("id"), F.col("t.heads").alias("heading"), tidy.alias("input"))
    action, role = classify(F.col("heading"), F.col("input"))
    return rows.select("*", target(F.col("input")).alias("target"), action.alias("action"), role.alias("role"))


def target(text: Column) -> Column:
    """What a task is about: the name after 'File:', else after 'function', else ''."""
    file, function = F.regexp_extract(text, r"File:\s*([^\s,]+)", 1), F.regexp_extract(text, r"function\s+[`']?([A-Za-z_]\w*)", 1)
    return F.when(file != "", file).otherwise(function)


def token_budget(action: Column, role: Column) -> Column:
    a, r = F.lower(F.coalesce(action, F.lit(""))), F.lower(F.coalesce(role, F.lit("")))
    return (
        F.when(a.isin("problems", "problem", "exercise", "generate"), 2400)
        .when((r == "coder") | a.isin("code", "fix", "review", "refactor"), 1400)
        .when((r == "reasoner") | a.isin("proof", "derive", "deep"), 2000)
        .otherwise(900)
    )


def too_short(answer: Column, least: int = 40) -> Column:
    return F.length(F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", "")) < least


def long_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]{4,})"), 1))


def shares_words(answer: Column, source: Column) -> Column:
    """Whether an answer has a word of four letters or more in common with its source."""
    return F.arrays_overlap(long_words(answer), long_words(source))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))


def anchors(source: Column) -> Column:
    """Numbers on the lines of a source that state an outcome."""
    stating = F.filter(F.split(F.coalesce(source, F.lit("")), "\r?\n"), lambda x: x.rlike(OUTCOME))
    return F.flatten(F.transform(stating, numbers))


def anchored(answer: Column, source: Column, question: Column) -> Column:
    """Whether a source states no number, the question asks for none, the answer says it is not there, or it has one of them."""
    a, x = anchors(source), numbers(answer)
    asks = F.coalesce(question, F.lit("")).rlike(INTENT)
    absent = F.lower(F.coalesce(answer, F.lit(""))).rlike(ABSENT)
    return (F.size(a) == 0) | ~asks | absent | F.exists(a, lambda p: F.exists(x, lambda q: F.abs(p - q) < 1e-6))


def within_budget(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose sizes sum to at most the budget; the first row always stays."""
    by = Window.partitionBy(group).orderBy(order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumns({"used": F.sum(size).over(upto), "rank": F.row_number().over(by)})
    return kept.where((F.col("used") <= budget) | (F.col("rank") == 1)).drop("rank")


def _fill(budget: int):
    """Batch numbers of rows that arrive in order; only the open batch is held, and a group may span any number of rows."""

    def run(frames):
        key, used, batch = None, 0, 1
        for frame in frames:
            out = []
            for g, s in zip(frame["g"].tolist(), frame["s"].tolist()):
                if g != key:
                    key, used, batch = g, 0, 1
                if used and used + s > budget:
                    used, batch = 0, batch + 1
                used += s
                out.append(batch)
            yield frame[["g", "o"]].assign(b=out)

    return run


def batches(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """group, order and batch number when rows are filled in order into batches of at most the budget.

    Rows stream through in order, so a hot group is one long pass in little memory.
    """
    kinds = dict(rows.dtypes)
    listed = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(size).cast("bigint").alias("s")).repartition("g").sortWithinPartitions("g", "o")
    out = listed.mapInPandas(_fill(budget), f"g {kinds[group]}, o {kinds[order]}, b int")
    return out.select(F.col("g").alias(group), F.col("o").alias(order), F.col("b").alias("batch"))


def merged_report(results: DataFrame) -> DataFrame:
    """run_id, report: the answers of a run in task order under headings; failed and ungrounded ones say so.

    results: run_id, task, result_id, role, output, error, grounded, grounding_note.
    """
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    shown = F.regexp_replace(F.coalesce("output", F.lit("")), r"\s+\z", "")
    note = F.coalesce(F.nullif("grounding_note", F.lit("")), F.lit("did not reproduce source.\n"))
    body = (
        F.when(failed, F.concat(F.lit("> ⚠️ worker failed: "), F.col("error"), F.lit("\n")))
        .when(shown == "", F.lit(None).cast("string"))
        .when(~F.coalesce(F.col("grounded"), F.lit(True)), F.concat(F.lit("> 🔴 UNGROUNDED — "), note, F.lit("\n\n"), shown, F.lit("\n")))
        .otherwise(F.concat(shown, F.lit("\n")))
    )
    part = F.concat_ws("\n", F.concat(F.lit("## Task "), F.col("task").cast("string"), F.lit(" · "), F.coalesce("role", F.lit("worker")), F.lit("\n")), body)
    rows = results.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("task", "result_id", part.alias("part")))).alias("parts"))
    return rows.select("run_id", F.array_join(F.transform("parts", lambda x: x["part"]), "\n").alias("report"))


def run_totals(results: DataFrame) -> DataFrame:
    """run_id with its answers and those that are ok."""
    return results.groupBy("run_id").agg(F.count_if("ok").alias("ok"), F.count("*").alias("total"))


def code_counts(results: DataFrame) -> DataFrame:
    """code and how often it was given."""
    return results.select(F.explode("error_codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def served(tasks: DataFrame, servers: int) -> DataFrame:
    """run_id, task, server: the tasks of a role in turn over its servers."""
    turn = F.row_number().over(Window.partitionBy("run_id", "role").orderBy("task")) - 1
    return tasks.select("run_id", "task", F.pmod(turn, F.lit(servers)).alias("server"))
