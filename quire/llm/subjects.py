"""Subject areas of documents by class-association rules.

A bounded labelled sample gives seed words. They label whole documents roughly. Parallel pattern growth over the
sentences of all documents then mines class-association rules {word} -> subject and, growing out of those,
{word, word} -> subject, no longer ones. Rounds of it replace the seeds, redundant rules are pruned, the rest score
every sentence, and a document has the subjects that hold at least a given share of its sentences. rounds=0 leaves
the seeds alone, which find clearly less.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.pairs import language
from quire.session import written

#: Rows of the labelled sample that are used at most, the smallest ids first.
SAMPLE = 100_000
#: A word needs this share of all words counted, a rule this share of all labelled sentences: both bound what is broadcast.
WORD_SHARE, RULE_SHARE = 5e-7, 5e-5
LEAST_LIFT, REDUNDANT, EVIDENCE = 1.6, 0.05, 1.0
#: Largest share of documents with a seed word; least share, strength per sentence and words of evidence of a document's leading subject; rounds of mining, the last with pairs.
COMMON, LEADS, STRENGTH, DISTINCT, ROUNDS = 0.3, 0.4, 1.5, 2, 2
#: Share that its two main subjects must hold of a word's uses; of those in documents without leading subject, what exceeds the usual rate counts.
PURE = 0.6
#: Lift of the documents without leading subject from which a word speaks for none.
IDLE_LIFT = 3.0

_HEADING = re.compile(r"^\s{0,3}#{1,6}\s")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_END = re.compile(r"(?<=[.!?。！？])[\"'”’)\]]*\s+")
_MATH = re.compile(r"\$\$.*?\$\$|\$[^$\n]{0,300}\$", re.DOTALL)
_WORD = re.compile(r"[a-zà-öø-ÿ]{3,}(?:-[a-zà-öø-ÿ]+)*|[가-힣]+")
# Particles at the end of Korean words, longest first.
_PARTICLE = re.compile(r"(?:에서는|으로는|이라는|에서|으로|에게|까지|부터|마다|처럼|보다|이나|이란|와|과|은|는|이|가|을|를|의|에|로|도|만)$")
_BROKEN = re.compile(r"(?<=[a-zà-öø-ÿ])[-‐‑¬–­][ \t]*\n(?=[a-zà-öø-ÿ])")


def sentences(text: str | None) -> list[str]:
    """Sentences and list items of a text; wrapped lines are joined, headings and lines without words left out."""
    out: list[str] = []
    for block in re.split(r"\n[ \t]*\n", text or ""):
        part: list[str] = []
        for line in block.split("\n"):
            if _HEADING.match(line):
                continue
            if _ITEM.match(line) and part:
                out.append(" ".join(part))
                part = []
            part.append(_ITEM.sub("", line.strip()))
        out.append(" ".join(part))
    return [s for p in out for s in _END.split(p) if len(_MATH.sub("", s).split()) >= 3]


def items(sentence: str, tongue: str) -> set[str]:
    """Words of a sentence that may be evidence, marked with its language; Korean ones without particle."""
    found = _WORD.findall(_MATH.sub(" ", sentence.lower()))
    return {f"{tongue}:{(_PARTICLE.sub('', w) if len(w) > 1 and '가' <= w[0] <= '힣' else w) or w}" for w in found}


def prepared(text: str | None) -> list[set[str]]:
    """Evidence words of each sentence; a sentence too short to tell its language takes that of the others."""
    parts = sentences(_BROKEN.sub("-", text or ""))
    tongues = [language(s) for s in parts]
    usual = Counter(t for t in tongues if t).most_common(1)
    return [items(s, t or (usual[0][0] if usual else "en")) for s, t in zip(parts, tongues)]


class Rules:
    """Evidence per subject of matching rules; a longer rule that matches replaces its parts."""

    def __init__(self, single: dict[str, dict[str, float]], double: dict[tuple[str, str], dict[str, float]] | None = None):
        self.single, self.double = single, double or {}
        self.after: dict[str, dict[str, dict[str, float]]] = defaultdict(dict)
        for (a, b), e in self.double.items():
            self.after[a][b] = e

    def __call__(self, words: set[str]) -> dict[str, float]:
        known = sorted(w for w in words if w in self.single)
        score: dict[str, float] = defaultdict(float)
        used: set[str] = set()
        if self.after:
            for k, a in enumerate(known):
                if (further := self.after.get(a)) is not None:
                    for b in known[k + 1 :]:
                        if (e := further.get(b)) is not None:
                            used |= {a, b}
                            for c, x in e.items():
                                score[c] += 2 * x
        for w in known:
            if w not in used:
                for c, x in self.single[w].items():
                    score[c] += x
        return score


def best(score: dict[str, float]) -> str | None:
    """The subject of a sentence: the highest evidence, when it is enough, not tied and not that for none."""
    if not score:
        return None
    (c, x), *rest = sorted(score.items(), key=lambda p: (-p[1], p[0]))
    return c if c and x >= EVIDENCE and (not rest or x - rest[0][1] > 1e-9) else None


def evidence(counts: dict[str, float], prior: dict[str, float], least: float = LEAST_LIFT) -> dict[str, float]:
    """Smoothed log lift of each subject that a word or rule speaks for."""
    n = sum(counts.values())
    out = {}
    for c, p in prior.items():
        lift = (counts.get(c, 0) + p) / (n + 1) / p
        if lift >= least:
            out[c] = math.log(lift)
    return out


def seed_rules(samples: list[tuple[str, str]], spread: dict[str, float]) -> Rules:
    """Words of labelled texts, weighted by rarity.

    spread: share of the documents of its language that hold a word. A word of more than COMMON of them, or
    one seen with a third subject, is no evidence.
    """
    counts: dict[str, Counter] = defaultdict(Counter)
    texts = Counter(c for c, _ in samples)
    for c, text in samples:
        for w in set().union(*prepared(text), set()):
            counts[w][c] += 1
    prior = {c: n / sum(texts.values()) for c, n in texts.items()}
    single = {}
    for w, k in counts.items():
        if len(k) <= 2 and (s := spread.get(w, 0.0)) <= COMMON and (e := evidence(k, prior)):
            single[w] = {c: x * math.log(1 / max(s, 1e-3)) for c, x in e.items()}
    return Rules(single)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [[sorted(p) for p in prepared(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.list_(pa.string())))], names=["doc_id", "parts"])


def _counted(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """Partial counts of the (word, subject) that `of` gives for the parts of a document."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        out = pa.RecordBatch.from_arrays([pa.array([w for w, _ in keys], pa.string()), pa.array([c for _, c in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["word", "subject", "n"])
        counts.clear()
        return out

    for batch in batches:
        for parts in batch.column(0).to_pylist():
            of(parts, counts)
        if len(counts) > 500_000:
            yield flush()
    if counts:
        yield flush()


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per word, and per language under its bare mark."""

    def of(parts, counts):
        words = set().union(*parts, set())
        counts.update((w, "") for w in words | {w[:3] for w in words})

    return _counted(batches, of)


def leading(rules: Rules, parts: list) -> str:
    """The subject that leads a whole document in evidence, '' where none does."""
    total: Counter = Counter()
    for p in parts:
        total.update(rules(p))
    c, x = total.most_common(1)[0] if total else ("", 0.0)
    words = set().union(*parts, set())
    if x < LEADS * sum(total.values()) or x < STRENGTH * len(parts) or sum(c in rules.single.get(w, ()) for w in words) < DISTINCT:
        return ""
    return c


def _patterns(shared, pairs: bool):
    """Partial counts of words by the subject that leads their document, and of pairs of ruled words in one sentence.

    Words with a rule are the header of the growth; a pair is counted under its first word, so that patterns of two
    words grow out of those of one and no longer ones are made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(*shared.value)

        def of(parts, counts):
            c = leading(rules, parts)
            for p in parts:
                counts.update((w, c) for w in p)
                if pairs:
                    known = sorted(w for w in p if w in rules.single)
                    counts.update((f"{a}\t{b}", c) for k, a in enumerate(known) for b in known[k + 1 :])

        return _counted(batches, of)

    return run


def mine(texts: DataFrame, rules: Rules, subjects: list[str], pairs: bool) -> Rules:
    """Class-association rules {word} -> subject and, with pairs, {word, word} -> subject, from counts over all documents.

    The class of a sentence is the subject that leads its document by the rules so far. A rule needs WORD_SHARE (of
    two words: RULE_SHARE) of all counts and evidence against the make-up of its own language. A word that is common in
    documents without a subject speaks for none. A two-word rule is redundant, and pruned, unless its confidence
    differs by more than REDUNDANT from that of both its words.
    """
    shared = texts.sparkSession.sparkContext.broadcast((rules.single, rules.double))
    counted = written(texts.select("parts").mapInArrow(_patterns(shared, pairs), "word string, subject string, n bigint").groupBy("word", "subject").agg(F.sum("n").alias("n")))
    two = F.contains("word", F.lit("\t"))
    total = counted.where(~two).agg(F.sum("n")).first()[0] or 0
    least = F.when(two, F.greatest(F.lit(3.0), F.lit(RULE_SHARE * total))).otherwise(F.greatest(F.lit(3.0), F.lit(WORD_SHARE * total)))
    frequent = counted.groupBy("word").agg(F.sum("n").alias("all")).where(F.col("all") >= least).select("word")
    by: dict[str, Counter] = defaultdict(Counter)
    sizes: dict[str, Counter] = defaultdict(Counter)
    for r in counted.join(frequent, "word").toLocalIterator():
        by[r["word"]][r["subject"]] = r["n"]
        if "\t" not in r["word"]:
            sizes[r["word"][:3]][r["subject"]] += r["n"]
    prior = {t: {c: (k[c] + 1) / (sum(k[x] for x in subjects) + len(subjects)) for c in subjects} for t, k in sizes.items()}
    rule = {w: e for w, k in by.items() if (e := _rule(k, sizes[w[:3]], prior[w[:3]], subjects))}
    single, double = {w: e for w, e in rule.items() if "\t" not in w}, {}
    for w, e in rule.items():
        if "\t" in w:
            a, b = w.split("\t")
            top = max(e, key=e.get)
            share = lambda x: by[x][top] / max(1, sum(by[x].values()))  # noqa: B023, E731
            if all(abs(share(w) - share(x)) > REDUNDANT for x in (a, b)):
                double[a, b] = e
    return Rules(single, double) if single else rules


def _rule(k: Counter, size: Counter, prior: dict[str, float], subjects: list[str]) -> dict[str, float]:
    """Evidence of a pattern with counts k by subject; size holds those of all words of its language."""
    held = sorted((k[c] for c in subjects), reverse=True)
    idle = size[""] / max(1, sum(size.values()))
    if sum(held[:2]) >= PURE * (sum(held) + max(0.0, k[""] - idle * sum(k.values()))) and (e := evidence({c: k[c] for c in subjects}, prior)):
        return e
    lift = (k[""] + idle) / (sum(k.values()) + 1) / max(idle, 1e-6)
    return {"": math.log(lift)} if lift >= IDLE_LIFT else {}  # speaks for no subject, as the words of prefaces do


def _assign(shared, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(*shared.value)
        for batch in batches:
            rows = []
            for ident, parts in zip(*(c.to_pylist() for c in batch.columns)):
                held = Counter(c for p in parts if (c := best(rules(p))))
                rows += [(ident, c, n, len(parts)) for c, n in sorted(held.items()) if n >= share * len(parts)]
            a, b, c, d = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.int32()), pa.array(d, pa.int32())], names=["doc_id", "subject", "sentences", "of"]
            )

    return run


def subject_rules(texts: DataFrame, samples: DataFrame, rounds: int = ROUNDS) -> tuple[dict, dict]:
    """Fit the rules: texts has `parts`, the evidence words of each sentence; samples has sample_id, subject, text."""
    labelled = samples.where("subject is not null and text is not null").orderBy("sample_id", "subject", "text").limit(SAMPLE)
    labelled = [(r["subject"], r["text"]) for r in labelled.select("subject", "text").toLocalIterator()]
    subjects = sorted({c for c, _ in labelled})
    if not subjects:
        return {}, {}
    counted = texts.select("parts").mapInArrow(_spread, "word string, subject string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written(counted)
    docs = {r["word"]: r["n"] for r in counted.where("length(word) = 3").collect()}  # one row per language
    wanted = sorted(set().union(*(p for _, t in labelled for p in prepared(t)), set()))  # words of the bounded sample
    spread = {r["word"]: r["n"] / docs[r["word"][:3]] for r in counted.where(F.col("word").isin(wanted)).toLocalIterator()} if len(wanted) < 5000 else {
        r["word"]: r["n"] / docs[r["word"][:3]] for r in counted.join(texts.sparkSession.createDataFrame([(w,) for w in wanted], "word string"), "word").toLocalIterator()
    }
    rules = seed_rules(labelled, spread)
    for turn in range(rounds):
        rules = mine(texts, rules, subjects, pairs=turn == rounds - 1)
    return rules.single, rules.double


def document_subjects(docs: DataFrame, samples: DataFrame, *, share: float = 0.25, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, subject, sentences, of: every subject that at least `share` of the sentences of a text belong to.

    docs: doc_id, text. samples: sample_id, subject, text, of which at most SAMPLE rows are used for the seeds;
    all further counting covers all documents. A null or blank text, or one without evidence, has no row; a
    sentence belongs to at most one subject. Rows repeated exactly count once in the result. Without samples
    the result is empty. Other columns are ignored; a very long text is treated whole.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    texts = written(rows.mapInArrow(_prepare, "doc_id bigint, parts array<array<string>>"))
    shared = docs.sparkSession.sparkContext.broadcast(subject_rules(texts, samples, rounds))
    return texts.mapInArrow(_assign(shared, share), "doc_id bigint, subject string, sentences int, of int").distinct()
