"""Defects of prompt and response pairs."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is in the terminal model when it makes at least this share of all words: at most 1 / SHARE words.
SHARE = 1e-6

# Fixed dictionaries: stand-ins for an answer, refusals, courtesies around them, asked-for languages, function words.
STAND_INS = {"", "n/a", "na", "null", "none", "nil", "nan", "-", "--", "—", "...", "…", ".", "?", "{}", "[]", '""', "tbd", "todo", "없음", "keine", "undefined"}
REFUSALS = re.compile(
    r"\b(?:can(?:no|')t|cannot|am (?:not able|unable) to|unable to|won't be able to|not able to) (?:help|assist|answer|comply|do that|provide)"
    r"|\bi (?:have to|must) (?:decline|pass|refuse)|\bsomething i have to decline|\bi(?:'d| would) rather not\b|\bi (?:won't|will not) be (?:writing|answering|doing)"
    r"|\bguidelines keep me\b|\bnot be right for me\b|\bno answer will be given\b|\breply from me would not\b|\boutside what i am allowed\b"
    r"|\btold to leave such tasks\b|\bi will leave it there\b|\bi (?:decline|refuse) to\b|\bnot allowed to (?:answer|discuss|help)"
    r"|\bnicht (?:weiter)?helfen|\bnicht (?:beantworten|bearbeiten)|\bkeine antwort\b|\blehne ich ab\b|\bdarf ich nicht\b"
    r"|답변을 드리지 않|답해 드릴 수 없|답변드릴 수 없|답변할 수 없|답할 수 없|도와드리기 어렵|도와드릴 수 없|다룰 수 있는 범위를 벗어|대답하지 않|응답할 수 없",
    re.IGNORECASE,
)
COURTESIES = re.compile(
    r"\b(?:sorry|apolog|thank you|hmm|please ask|different book|another topic|let me know|is noted|anything else|study helper|unfortunately|entschuld|leid|danke|bitte fragen|문의해|죄송|감사)", re.IGNORECASE
)
ASKED = (
    ("ko", re.compile(r"\b(?:in|auf) (?:korean|koreanisch)\b|한국어로|한국말로", re.IGNORECASE)),
    ("de", re.compile(r"\b(?:in|auf) (?:german|deutsch)\b|독일어로", re.IGNORECASE)),
    ("en", re.compile(r"\b(?:in|auf) (?:english|englisch)\b|영어로", re.IGNORECASE)),
)
FUNCTION_WORDS = {
    "en": frozenset("the a an of and to is in that it for with as on by this which not be are was from at or one only such when has have its how why what there then".split()),
    "de": frozenset("der die das und ist in den von zu mit sich des auf für nicht ein eine dem es an als auch wie wird zeigt wenn dass ob lässt was im warum oder wurde hier nur noch wegen nach".split()),
}
OPEN_WORDS = frozenset(
    "the a an of and or but to in on at by for with from because since although which that if when while whose is are was were be than as whereas unless until so then therefore hence thus"
    " und oder aber weil dass der die das ein eine mit von zu im wenn ob denn deshalb sodass 그리고 왜냐하면 그러나 따라서 또는 및 하지만 그래서 만약".split()
)
CONCLUSION = re.compile(r"(?:answer is|antwort(?: ist)?|ergebnis ist|답은|정답은|답:|answer:|result:|=)\s*\**[-+]?(?:\$[^$]*\$|[\w.,/^{}\\%()]*\d[\w.,/^{}\\%()]*)\**$", re.IGNORECASE)

_THINK = re.compile(r"<think>.*?</think>", re.DOTALL | re.IGNORECASE)
_OPEN_THINK = re.compile(r"<think>.*\Z", re.DOTALL | re.IGNORECASE)
_FENCE = re.compile(r"```[^\n]*\n?.*?```", re.DOTALL)
_MATH = re.compile(r"\$\$.*?\$\$|\$[^$\n]*\$", re.DOTALL)
_BLANK = re.compile(r"[\s​‌‍⁠﻿­]+")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'”’)\]]*\s+|\n+")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_HANGUL = re.compile(r"[가-힣]")
_LATIN = re.compile(r"[A-Za-zÀ-ÿ]")


def visible(answer: str | None) -> str:
    """The answer without hidden reasoning; an unclosed block of it hides the rest."""
    return _OPEN_THINK.sub("", _THINK.sub("", answer or "")).strip().strip("​﻿").strip()


def is_empty(text: str) -> bool:
    bare = _BLANK.sub(" ", text).strip().lower()
    if bare in STAND_INS:
        return True
    if not _BLANK.sub("", re.sub(r"```[\w-]*", "", text)):
        return True
    lines = [x for x in text.split("\n") if x.strip()]
    return all(x.lstrip().startswith("#") for x in lines)  # headings with nothing below


def language(text: str) -> str | None:
    """en, de or ko of a sentence by script and function words; null when it has too little text to tell."""
    bare = _MATH.sub(" ", text)
    hangul, latin = len(_HANGUL.findall(bare)), len(_LATIN.findall(bare))
    if hangul >= 2 and hangul * 2 >= latin:
        return "ko"
    seen = [w.lower() for w in _WORD.findall(bare)]
    if len(seen) < 2 or latin < 6:
        return None
    en, de = (sum(w in FUNCTION_WORDS[k] for w in seen) for k in ("en", "de"))
    de += sum(any(c in w for c in "äöüß") for w in seen)
    return None if en == de else "en" if en > de else "de"


def wrong_language(question: str, text: str) -> bool:
    want = next((k for k, p in ASKED if p.search(question)), None) or language(question)
    if want is None:
        return False
    said = [k for s in _SENTENCE.split(_FENCE.sub(" ", text)) if (k := language(s)) is not None]
    return bool(said) and 2 * sum(k != want for k in said) > len(said)


def is_refusal(text: str) -> bool:
    """Refusing sentences without more than one sentence of other content."""
    parts = [s for s in _SENTENCE.split(_FENCE.sub(" ", text.replace("’", "'"))) if s.strip()]
    refusing = sum(bool(REFUSALS.search(s)) for s in parts)
    other = sum(not REFUSALS.search(s) and not COURTESIES.search(s) for s in parts)
    return refusing > 0 and other <= 1 and other <= refusing


def compressed(text: bytes, prompt: bytes) -> int:
    """Bytes of the response when the prompt is its zstandard dictionary."""
    known = zstandard.ZstdCompressionDict(prompt, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=9, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text))


def is_copy(question: str, text: str) -> bool:
    """The prompt as dictionary leaves almost nothing of the response, and almost no word of it is new."""
    if not question.strip():
        return False
    q, a = (" ".join(_WORD.findall(x.casefold())) for x in (question, text))
    if not q or not a or compressed(a.encode(), q.encode()) > 14 + 0.25 * len(a.encode()):
        return False
    known, said = set(q.split()), a.split()
    fresh = [w for w in said if w not in known]
    covered = len(known & set(said)) / len(known)
    return len(fresh) <= max(3, 0.2 * len(said)) and len(fresh) < 0.5 * len(said) and covered >= 0.6


class Endings:
    """Terminal-context model: how often a word, seen last, ends a sentence or an item."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.counts = counts

    def __call__(self, word: str) -> float:
        ends, seen = self.counts.get(word.lower(), (0, 0))
        return (ends + 0.1) / (seen + 1.0)


def is_truncated(text: str, endings: Endings) -> bool:
    if text.count("```") % 2:
        return True
    plain = _FENCE.sub("\n\n", text).rstrip()
    if not plain:
        return False
    if plain[0] in "{[" and re.match(r'[{\[]\s*["{\[\]}]', plain):
        try:
            json.loads(plain)
            return False
        except ValueError:
            return True
    if text.rstrip().endswith("```"):
        return False
    if plain.count("$$") % 2 or _MATH.sub("", plain).replace("\\$", "").count("$") % 2:
        return True
    lines = [x.strip() for x in plain.split("\n") if x.strip()]
    last = lines[-1]
    if len(lines) > 1 and re.fullmatch(r"\d+[.)]", last) and _ITEM.match(lines[-2]):
        return True
    bare = last.rstrip("\"'”’)]*_`")
    if not bare or bare[-1] in ".!?。！？…":
        return False
    if re.fullmatch(r"(?:\$\$?[^$]+\$\$?[\s,]*)+", last) or last.startswith(("|", "#")):
        return False  # a formula, table row or heading of its own
    if bare[-1] in ",;:(-–—、":
        return True
    seen = _WORD.findall(_MATH.sub(" 0 ", bare))
    if not seen:
        return False
    if seen[-1].lower() in OPEN_WORDS:
        return True
    if CONCLUSION.search(bare):
        return False
    items = [x for x in lines if _ITEM.match(x)]
    others = [x for x in lines[:-1] if not x.endswith("```")]
    if _ITEM.match(last):
        if all(x.rstrip("\"'”’)]*_`")[-1:] in ".!?。" for x in items[:-1]) and len(items) > 1:
            return True
        return endings(seen[-1]) < 0.02 and not seen[-1][0].isdigit()
    if len(seen) <= 4 and not others:
        return False  # a bare term or number is a whole answer
    return True


def defect(question: str | None, answer: str | None, endings: Endings) -> str | None:
    """The defect of one pair: empty, refusal, copy, truncated or language, the first that holds; else null."""
    text, question = visible(answer), question or ""
    if is_empty(text):
        return "empty"
    if is_refusal(text):
        return "refusal"
    if is_copy(question, text):
        return "copy"
    if is_truncated(text, endings):
        return "truncated"
    return "language" if wrong_language(question, text) else None


def _ending_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words, all and before the end of a sentence or item."""
    seen, ends = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        words = list(seen)
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([ends[w] for w in words], pa.int64()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "ends", "seen"])
        seen.clear()
        ends.clear()
        return out

    for batch in batches:
        for answer in batch.column(0).to_pylist():
            lines = [x for x in visible(answer).split("\n") if x.strip()]
            for k, line in enumerate(lines):
                for s in _SENTENCE.split(line):
                    w = _WORD.findall(s.lower())
                    seen.update(w)
                    if w and (k < len(lines) - 1 or s.rstrip()[-1:] in ".!?。"):
                        ends[w[-1]] += 1
        if len(seen) > 500_000:
            yield flush()
    if seen:
        yield flush()


def fit_endings(answers: DataFrame, share: float = SHARE) -> dict[str, tuple[int, int]]:
    """Terminal counts over all answers of the words with at least the given share of all: at most 1 / share words."""
    counts = answers.mapInArrow(_ending_counts, "word string, ends bigint, seen bigint").groupBy("word").agg(F.sum("ends").alias("ends"), F.sum("seen").alias("seen"))
    total = counts.agg(F.sum("seen")).first()[0] or 0
    return {r["word"]: (r["ends"], r["seen"]) for r in counts.where(F.col("seen") >= max(2, share * total)).toLocalIterator()}


def _label(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings = Endings(shared.value)
        for batch in batches:
            ident, question, answer = (c.to_pylist() for c in batch.columns)
            found = [(i, d) for i, q, a in zip(ident, question, answer) if (d := defect(q, a, endings))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())], names=["result_id", "defect"])

    return run


def defective_pairs(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """result_id and defect of every defective pair.

    results: result_id, run_id, task, output; tasks: run_id, task, input. A repeated result counts once (of
    different rows under one id the one with the greatest output), and so does a repeated task. A null output
    is empty. Without a task, or with a null input, the question is empty text: it can be no copy and asks for
    no language. A null result_id gives no row. Other columns are ignored; empty tables give no rows.

    Each pair gets at most one label: empty, refusal, copy, truncated, language, in this order. The terminal
    model is counted over all outputs; its words are bounded by SHARE, so it may be broadcast.
    """
    spark = results.sparkSession
    once = results.where("result_id is not null").groupBy("result_id").agg(F.max(F.struct("output", "run_id", "task")).alias("r")).select("result_id", "r.*")
    asked = tasks.groupBy("run_id", "task").agg(F.max("input").alias("input"))
    shared = spark.sparkContext.broadcast(fit_endings(results.select("output")))
    pairs = once.join(asked, ["run_id", "task"], "left").select(F.col("result_id").cast("bigint").alias("result_id"), "input", "output")
    return pairs.mapInArrow(_label(shared), "result_id bigint, defect string")
