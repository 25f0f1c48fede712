"""Gates over answers: words and formulas shared with sources, structure of problem sets, results of code, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.answers import requested_count
from quire.operators.planning import long_words, too_short

# Formulas, boundaries and marks of problems, orders, codes of verdicts and their meaning.
LATEX = r"(\\[a-zA-Z]+\s*[\w{}\\^+*/=<\]]{2,90})"
PROBLEM = r"(?m)^\s*(?=(?:PROBLEM\s*\d+|#+\s*Problem\b|문제\s*\d+|Question\s+[0-9]+|Problem\s*[0-9]+|[0-9]+[.)]))"
RUN_PROBLEM = r"(?m)^\s*(?=(?:PROBLEM|문제)|(?:\d+\s*[.)]\s*(?:Question|문제)))"
SOLUTION = r"(?i)(Solution key|Solution:|Answer[:：]|답:|풀이:|Key:)"
ORDER = r"(?i)(find|compute|evaluate|show that|prove|decide|test|determine|solve|check|is it|converge|classify|which n|how many|for what)"
META = r"(?i)(?:formulate|design|make up|make|create|construct|invent)\s+(?:\w+\s+)?(?:problem|exercise|question|example|task)\b|students?\s+must"
TARGET = (
    r"(?i)\b(find|compute|evaluate|determine|calculate|solve for|which n|smallest|least|how many terms|how many|first \d+\s*terms|"
    r"find the (?:sum|value|limit|root|integral|partial sum)|remainder\s*[<≤]|error\s*[<≤]|within|accurate to|to three decimals)\b"
)
INDEX = r"\b(find|smallest|least|how many|which n|terms|fewest|index|first .* terms)\b"
CHOICE = r"\b(is .* (larger|smaller)|compare|which|true or false)\b"
PLACEHOLDER = r"<<RESULT>>|<<result>>"
VERDICTS = {
    "OK": ("", ""),
    "ERR_SOURCE": ("source_violation", "source_violation: problem/solution uses a fact absent from the source"),
    "ERR_LOGIC": ("logic_error", "logic_error: bound collapse / impossible condition / internal contradiction"),
    "ERR_SYMPY": ("hand_calculation_error", "hand_calculation_error: numeric problem lacks a runnable block or its output is unmatched"),
    "ERR_STRUCT": ("structural_missing", "structural_missing: required fields (Question/Solution key) missing"),
    "ERR_META": ("meta_question", "meta_question: not a concrete problem (e.g. 'Formulate a problem...')"),
}
UNKNOWN = ("other", "other: judge returned an unknown code")


def formulas(text: Column) -> Column:
    """TeX commands with what follows them, of eight characters or more."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LATEX), 1), lambda x: F.length(x) >= 8)


def lexical(answer: Column, sources: Column) -> Column:
    """Why an answer passes or fails beside its sources (array of texts): free, short, words, formula or off-topic."""
    shared = F.exists(sources, lambda s: F.arrays_overlap(long_words(answer), long_words(s)))
    formula = F.exists(sources, lambda s: F.exists(formulas(s), lambda f: F.contains(answer, f)))
    return (
        F.when(sources.isNull() | (F.size(sources) == 0), F.lit("free"))
        .when(too_short(answer), F.lit("short"))
        .when(F.coalesce(shared, F.lit(False)), F.lit("words"))
        .when(F.coalesce(formula, F.lit(False)), F.lit("formula"))
        .otherwise(F.lit("off-topic"))
    )


def accepted(reason: Column) -> Column:
    return reason.isin("free", "words", "formula")


def blocks(text: Column, pattern: str = PROBLEM) -> Column:
    """Problems of a set, cut before each; what stands before the first is left out, a set without marks is one block."""
    body = F.coalesce(text, F.lit(""))
    parts = F.split(body, pattern)
    rest = F.when(_starts(body, pattern), parts).otherwise(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))))
    return F.filter(F.transform(F.when(F.size(parts) > 1, rest).otherwise(F.array(body)), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")


def _starts(text: Column, pattern: str) -> Column:
    return F.ltrim(text).rlike(r"\A" + pattern.removeprefix("(?m)^").replace(r"\s*", "", 1))


def problem_set(question: Column, answer: Column, sources: Column) -> Column:
    """Why a set of problems passes or fails: short, few, meta, structure, the lexical reasons, or ok."""
    parts = blocks(answer)
    meta = F.exists(parts, lambda b: b.rlike(META) & ~b.rlike(SOLUTION))

    def whole(b: Column) -> Column:
        asks = F.contains(F.lower(b), F.lit("question")) | b.rlike("[?:]")
        return asks & b.rlike(SOLUTION) & (b.rlike(r"\d") | b.rlike(ORDER))

    reason = lexical(answer, sources)
    return (
        F.when(too_short(answer), F.lit("short"))
        .when(F.size(parts) < requested_count(question), F.lit("few"))
        .when(meta, F.lit("meta"))
        .when(~F.forall(parts, whole), F.lit("structure"))
        .when(~accepted(reason), reason)
        .otherwise(F.lit("ok"))
    )


def category(question: Column, solution: Column) -> Column:
    """What a problem asks for: index, bool or value."""
    t = F.lower(F.concat_ws(" ", F.coalesce(question, F.lit("")), F.coalesce(solution, F.lit(""))))
    return F.when(t.rlike(INDEX), F.lit("index")).when(t.rlike(CHOICE), F.lit("bool")).otherwise(F.lit("value"))


def states_value(text: Column, value: Column, within: float = 1e-6) -> Column:
    """Whether a value is written in a text: a whole one not as part of a number or fraction, another one within a tolerance."""
    t = F.coalesce(text, F.lit(""))
    whole = F.exists(F.regexp_extract_all(t, F.lit(r"(?<![\d./])\s*(\d+)(?!\d)"), 1), lambda x: x.cast("double") == F.round(value))
    real = F.exists(F.regexp_extract_all(t, F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), 1), lambda x: F.abs(x.cast("double") - value) <= within)
    return F.coalesce(F.when(F.abs(value - F.round(value)) < 1e-9, whole).otherwise(real), F.lit(False))


def execution(runs: DataFrame) -> DataFrame:
    """runs with requires, code ('' passes) and placeholder: the gate over executed code.

    runs: text (one problem), runs array<struct<ok boolean, value double, error string>>, one entry for each code block, in
    order. Running code is the caller's; here results are judged: missing_code_block, execution_error,
    inconsistent_result or value_mismatch, the first that holds.
    """
    text, done = F.col("text"), F.coalesce(F.col("runs"), F.array().cast("array<struct<ok:boolean,value:double,error:string>>"))
    holder = text.rlike(PLACEHOLDER)
    requires = (F.size(done) > 0) | holder | (text.rlike(TARGET) & text.rlike(r"\d"))
    finite = F.filter(F.transform(done, lambda r: r["value"]), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    counts = (category(text, F.lit("")) == "index") & ~F.exists(finite, lambda v: v > 0)
    code = (
        F.when(~requires, F.lit(""))
        .when(F.size(done) == 0, F.lit("missing_code_block"))
        .when(F.exists(done, lambda r: ~r["ok"]), F.lit("execution_error"))
        .when(holder & (F.size(finite) == 0), F.lit("execution_error"))
        .when(F.size(finite) == 0, F.lit("inconsistent_result"))
        .when(counts, F.lit("inconsistent_result"))
        .when(~holder & F.exists(finite, lambda v: ~states_value(text, v)), F.lit("value_mismatch"))
        .otherwise(F.lit(""))
    )
    return runs.withColumns({"requires": requires, "code": code, "placeholder": F.when(holder & (code == ""), F.element_at(finite, -1))})


def verdict(reply: Column) -> Column:
    """ok, grounded, reason, errors, exceptions, error_codes of a judge's JSON reply: short form {ok, code} or long form."""
    v = F.from_json(reply, "struct<ok:boolean,grounded:boolean,code:string,reason:string,errors:string,exceptions:string,error_codes:string>")
    shaped = F.get_json_object(reply, "$").rlike(r"^\s*\{")
    pairs = F.create_map(*(F.lit(x) for k, (c, _) in VERDICTS.items() for x in (k, c)))
    reasons = F.create_map(*(F.lit(x) for k, (_, r) in VERDICTS.items() for x in (k, r)))
    code = F.upper(F.trim(v["code"]))
    name, why = F.coalesce(F.try_element_at(pairs, code), F.lit(UNKNOWN[0])), F.coalesce(F.try_element_at(reasons, code), F.lit(UNKNOWN[1]))
    short = v["code"].isNotNull() & v["ok"].isNotNull()
    none = F.array().cast("array<string>")

    def listed(x: Column) -> Column:
        return F.when(x.rlike(r"^\s*\["), F.coalesce(F.from_json(x, "array<string>"), none)).when(F.coalesce(x, F.lit("")) != "", F.array(x)).otherwise(none)

    ok = F.coalesce(v["ok"], v["grounded"], F.lit(False))
    return (
        F.when(
            ~F.coalesce(shaped, F.lit(False)) | v.isNull(),
            _verdict(F.lit(False), F.lit(False), F.lit("judge reply not a dict"), none, none, none),
        )
        .when(short, _verdict(v["ok"], v["ok"], F.concat(F.lit("judge: "), F.when(why == "", F.lit("OK")).otherwise(why)), none, none, F.when(name == "", none).otherwise(F.array(name))))
        .otherwise(_verdict(ok, F.coalesce(v["grounded"], ok), F.coalesce(v["reason"], F.lit("")), listed(v["errors"]), listed(v["exceptions"]), listed(v["error_codes"])))
    )


def _verdict(*values: Column) -> Column:
    return F.struct(*(x.alias(n) for n, x in zip(("ok", "grounded", "reason", "errors", "exceptions", "error_codes"), values)))


def said(v: Column) -> Column:
    """A verdict as one line."""
    parts = F.concat(
        F.array(v["reason"]),
        F.transform(v["errors"], lambda e: F.concat(F.lit("err: "), e)),
        F.when(F.size(v["error_codes"]) > 0, F.array(F.concat(F.lit("codes: "), F.array_join(v["error_codes"], ",")))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(v["exceptions"]) > 0, F.array(F.concat(F.lit("unchecked-exceptions: "), F.array_join(v["exceptions"], ", ")))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_join(F.filter(parts, lambda x: x != ""), " | ")


def unique_numbers(text: Column) -> Column:
    """Numbers of a text, each once, in order, to six decimals."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: F.round(x.cast("double"), 6))
    return F.array_sort(F.array_distinct(found))
