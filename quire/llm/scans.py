"""Noise in text from scanned pages: find it line by line, and repair it into continuous paragraphs.

Words are counted over all texts; those of at least a fixed share of all words make the lexicon, so it has at
most 1 / SHARE words however large the corpus is and may be broadcast. A symmetric-delete index over the
lexicon gives candidates, an edit distance weighted by confusion pairs and the ratio of frequencies decide
whether a rare word is a misread common one, and bigram counts pick between several repairs.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import written

SHARE, PAIR_SHARE = 1e-6, 2e-6
#: A word of fewer uses is no lexicon word; a misread is at least RATIO times rarer than its repair.
LEAST, RATIO = 4, 12
#: Weighted distances: most of a repair by confusion pairs, cost of an edit that is no confusion.
CLOSE, EDIT = 1.05, 1.0

# What scanning takes for what, as (read, meant, cost).
CONFUSIONS = (
    ("rn", "m", 0.3), ("m", "rn", 0.3), ("cl", "d", 0.3), ("d", "cl", 0.3), ("li", "h", 0.3), ("h", "li", 0.3), ("ii", "u", 0.3), ("u", "ii", 0.3),
    ("vv", "w", 0.3), ("w", "vv", 0.3), ("c", "e", 0.3), ("e", "c", 0.3), ("o", "c", 0.5), ("c", "o", 0.5), ("l", "i", 0.4), ("i", "l", 0.4),
    ("nn", "m", 0.4), ("in", "m", 0.4), ("ni", "m", 0.4), ("m", "in", 0.4), ("m", "nn", 0.4), ("f", "t", 0.4), ("t", "f", 0.4), ("u", "n", 0.5), ("n", "u", 0.5),
    ("a", "o", 0.5), ("o", "a", 0.5), ("s", "a", 0.6), ("b", "h", 0.4), ("h", "b", 0.4), ("y", "v", 0.5), ("v", "y", 0.5), ("tt", "ti", 0.5), ("l", "t", 0.5),
    ("t", "l", 0.5), ("ri", "n", 0.4), ("n", "ri", 0.4), ("fi", "h", 0.5), ("lj", "y", 0.5), ("g", "q", 0.4), ("q", "g", 0.4), ("j", "i", 0.5), ("1", "l", 0.1),
    ("1", "i", 0.1), ("0", "o", 0.1), ("5", "s", 0.1), ("6", "b", 0.1), ("9", "g", 0.1), ("8", "b", 0.2), ("2", "z", 0.2), ("!", "i", 0.1), ("!", "l", 0.2),
    ("|", "l", 0.1), ("3", "e", 0.3), ("4", "a", 0.3), ("7", "t", 0.3), ("l", "1", 0.1), ("o", "0", 0.1),
)
# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕкмнтвԁһԛԝАЕОРСУХІЈЅКМНТВοονаαρι", "aeopcyxijskmhtbdhqwAEOPCYXIJSKMHTBoovaapi")
DIGITS = str.maketrans("0156!|89", "olsbilbg")
PARTICLES = frozenset("은는이가을를의에와과도로만서며고면")  # a change of one of these at the end is grammar
GLYPH = re.compile(r"/[HG]\d{2,}|\(cid:\d+\)")
SIGNS = "-‐‑¬–\xad"

_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*|[가-힣]+")
_MATHY = re.compile(r"[$\\_^{}=<>()\[\]/*#`@~+]|\w\.\w{3}|^[+\-]?\d")
_STRIP = " .,;:?\"'“”‘’…|¦"
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
_PAGE = re.compile(
    r"(?:[-–—·•*|]\s*)?(?:(?:p[a@]g[e3c]|pa9e|pagc|p\.|pg\.?|s\.|seite|쪽|page)\s*)?[\[(]?\s*(?:(?=[\dOolISZB|!]*\d)[\dOolISZB|!]{1,5}|[lIO][lIO]{0,3}|[ivxlc]{2,7}|[ivx])\s*[\])]?(?:\s*(?:쪽|[-–—·•*|]))?(?:\s*/\s*\d{1,5})?",
    re.IGNORECASE,
)
_BARE = re.compile(r"\d{1,6}")
_HEADING = re.compile(r"#{1,6}\s")
_ENDS_CUT = re.compile(rf"([^\W\d_][^\s]*?)[{SIGNS}]\s*$")


class Lexicon:
    """Frequent words with a symmetric-delete index; verdicts on single words are remembered."""

    def __init__(self, counts: dict[str, int], share: float = SHARE):
        self.counts = counts
        #: Uses that speak for a word itself: a share of all words, so that a misread gains none by a larger corpus.
        self.common = max(40 * LEAST, 40 * share * sum(counts.values()))
        self.deletes: dict[str, list[str]] = defaultdict(list)
        for w in counts:
            if len(w) > 3 and "가" > w[0]:
                for k in range(len(w)):
                    self.deletes[w[:k] + w[k + 1 :]].append(w)
        self.hangul: dict[str, list[str]] = defaultdict(list)
        for w in counts:
            if "가" <= w[0] <= "힣" and len(w) > 1:
                for k in range(len(w)):
                    self.hangul[f"{w[:k]}?{w[k + 1 :]}"].append(w)
        self.known: dict[str, list[tuple[float, str]]] = {}

    def frequency(self, word: str) -> int:
        return self.counts.get(word, 0)

    def repairs(self, word: str, firm: bool = False) -> list[tuple[float, str]]:
        """(cost, repair) of words much more frequent than this one, cheapest first; firm: by confusion pairs only."""
        key = f"{word}\0" if firm else word
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            found = self.known[key] = self._repairs(word, firm)
        return found

    def _repairs(self, word: str, firm: bool) -> list[tuple[float, str]]:
        least = max(LEAST * 2, RATIO * self.frequency(word))
        best: dict[str, float] = {}
        if "가" <= word[0] <= "힣":
            for k in range(len(word)):
                for c in self.hangul.get(f"{word[:k]}?{word[k + 1 :]}", ()):
                    if c != word and self.counts[c] >= least and (d := syllable(word[k], c[k])) < 1:
                        best[c] = min(best.get(c, 9), d)
            return sorted((d, c) for c, d in best.items() if not (word[-1] in PARTICLES and c[-1] in PARTICLES and word[:-1] == c[:-1]))
        front = {word: 0.0}
        for _ in range(3):  # up to three confusions
            further: dict[str, float] = {}
            for w, d in front.items():
                for read, meant, cost in CONFUSIONS:
                    if d + cost <= CLOSE:
                        at = w.find(read)
                        while at >= 0:
                            v = w[:at] + meant + w[at + len(read) :]
                            if v not in front and d + cost < further.get(v, 9):
                                further[v] = d + cost
                            at = w.find(read, at + 1)
            for v, d in further.items():
                if v != word and self.counts.get(v, 0) >= least:
                    best[v] = min(best.get(v, 9), d)
            if best or len(further) > 600:
                break
            front = further
        if not firm and not best and len(word) > 4:
            for k in range(len(word) + 1):
                for c in (*self.deletes.get(word, ()), *(self.deletes.get(word[:k] + word[k + 1 :], ()) if k < len(word) else ())):
                    if c != word and self.counts[c] >= 4 * least and self._inner(word, c):
                        best[c] = EDIT
                if k < len(word) - 1 and self.counts.get(v := word[:k] + word[k + 1 :], 0) >= 4 * least and self._inner(word, v):
                    best[v] = EDIT
        return sorted((d, c) for c, d in best.items())

    @staticmethod
    def _inner(a: str, b: str) -> bool:
        """One edit apart, and not at the end, where inflections differ."""
        p = 0
        while p < min(len(a), len(b)) and a[p] == b[p]:
            p += 1
        s = 0
        while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
            s += 1
        return s > 1 and max(len(a), len(b)) - p - s <= 1


def syllable(a: str, b: str) -> float:
    """Distance of two Hangul syllables: 0.5 when one part of them differs, 1.5 otherwise."""
    if not ("가" <= a <= "힣" and "가" <= b <= "힣"):
        return 1.5
    x, y = ord(a) - 0xAC00, ord(b) - 0xAC00
    same = (x // 588 == y // 588) + (x % 588 // 28 == y % 588 // 28) + (x % 28 == y % 28)
    return 0.5 if same == 2 else 1.5


class Reader:
    """Judges tokens and lines against a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.good: set[str] = set()
        self.bad: dict[str, str] = {}  # token -> its core

    def misread(self, token: str) -> bool:
        if token in self.good:
            return False
        if token in self.bad:
            return True
        if len(self.good) > 1_000_000:
            self.good.clear()
        if self._misread(token):
            if len(self.bad) > 200_000:
                self.bad.clear()
            self.bad[token] = token
            return True
        self.good.add(token)
        return False

    def _misread(self, token: str) -> bool:
        if "�" in token or GLYPH.search(token):
            return True
        if token.isascii() and token.isdigit():
            return False
        if _FOREIGN.search(token) and re.search("[A-Za-z]", token) and not re.search(r"[\\$_^{}]", token):
            return True
        core = token.strip(_STRIP)
        if not core:
            return False
        if re.search("[가-힣]", core):
            return self._hangul(core)
        lead = core.lstrip("!").lower()
        if re.search(r"[A-Za-z]![a-z]|^![a-z]{2}", core) and not _MATHY.search(core.replace("!", "i")):
            return True
        core = core.rstrip("!")
        if any(c.isdigit() for c in core):
            return self._digits(core)
        if _MATHY.search(core) or not lead.isascii():
            return False
        w = core.lower().strip("-–—'")
        if not w.replace("-", "").isalpha() or (core.isupper() and len(core) > 1):
            return False
        return self.word(w, core[0].isupper())

    def word(self, w: str, capital: bool) -> bool:
        """Whether a plain lower-cased word is a misread one."""
        lex = self.lexicon
        if len(w) < 2 or lex.frequency(w) >= lex.common and not lex.repairs(w, True):
            return False
        if "-" in w and not lex.frequency(w):
            parts = [p for p in w.split("-") if p]
            return any(len(p) > 3 and not lex.frequency(p) and lex.repairs(p, True) for p in parts)
        if lex.frequency(w) >= lex.common:
            return lex.counts[lex.repairs(w, True)[0][1]] >= 4 * RATIO * lex.frequency(w) and lex.repairs(w, True)[0][0] <= 0.3
        found = lex.repairs(w, capital or len(w) < 5 or lex.frequency(w) >= LEAST)
        return bool(found) and (not capital or found[0][0] <= 0.5 and lex.counts[found[0][1]] >= 50 * LEAST)

    def _digits(self, core: str) -> bool:
        if re.fullmatch(r"(?=.*\d)(?=.*[OlI])[\dOlI]{2,6}", core):
            return True
        if re.search(r"[$\\_^{}=<>()\[\]/*#`@~+]", core) or not core.isascii():
            return False
        m = re.fullmatch(r"[A-Za-z0-9|-]+", core)
        if not m:
            return False
        if re.fullmatch(r"[A-Z][a-z]*\d[a-z]*|[A-Z][a-z]+\d{1,2}", core) and len(core) > 3:
            return True
        if re.search(r"[a-z]\d{1,2}[a-z]", core) and sum(c.isalpha() for c in core) >= 3:
            return True
        w = core.lower()
        return sum(c.isalpha() for c in w) >= 2 and (self.lexicon.frequency(w.translate(DIGITS)) >= LEAST or any(d <= 0.9 for d, _ in self.lexicon.repairs(w, True)))

    def _hangul(self, core: str) -> bool:
        if re.search(r"[가-힣]\d|[가-힣][!|][가-힣]", core):
            return True
        w = re.sub(r"^[\d.,%]+|[^가-힣]+$", "", core)
        if not re.fullmatch("[가-힣]+", w) or len(w) < 2 or self.lexicon.frequency(w) >= self.lexicon.common:
            return False
        return bool(self.lexicon.repairs(w))

    def lines(self, text: str, titles: list[str]) -> list[tuple[int, str, str]]:
        """(line index, kind, detail) of the noise; detail of a hyphen is the joined word, of a misread line its tokens."""
        suspects = {t for t in set(text.split()) - self.good if self.misread(t)}
        if "\n" not in text and not suspects:
            return []
        rows = text.split("\n")
        kinds = self._layout(rows, titles)
        out = [(k, kind, "") for k, kind in sorted(kinds.items()) if kind in ("header", "page_number")]
        cuts: dict[int, str] = {}  # line -> kind of its first word: the rest of a cut word
        for k, row in enumerate(rows):
            if kinds.get(k) or not row or row.rstrip()[-1:] not in SIGNS:
                continue
            if (m := _ENDS_CUT.search(row.rstrip())) is None:
                continue
            j = k + 1
            while j < len(rows) and (kinds.get(j) in ("header", "page_number") or not rows[j].strip()):
                j += 1
            if j < len(rows) and (joined := self._joined(m.group(1), row.rstrip()[-1], rows[j])) is not None:
                word, own, wrong = joined
                if not own:
                    out.append((k, "hyphen", word))
                if wrong is not None:
                    out.extend((x, "misread", "") for x in ([k] if wrong != 1 else []) + ([j] if wrong != 0 else []))
                cuts[k], cuts[j] = cuts.get(k, "") + "e", cuts.get(j, "") + "s"
        if suspects:
            for k, row in enumerate(rows):
                if kinds.get(k):
                    continue
                tokens = row.split()
                cut = cuts.get(k, "")
                inner = tokens["s" in cut : len(tokens) - ("e" in cut)]
                wrong = [t for t in inner if t in suspects]
                wrong += [t for t in (*tokens[: "s" in cut], *(tokens[-1:] if "e" in cut else ())) if "�" in t or _FOREIGN.search(t) or re.search(r"[a-z][0-9!][a-z]", t)]
                if wrong and not self._mathematical(row, wrong):
                    out.append((k, "misread", "\0".join(wrong)))
        return out

    @staticmethod
    def _mathematical(row: str, tokens: list[str]) -> bool:
        bare = re.sub(r"\$[^$]*(?:\$|$)", " ", row)
        return not any(t in bare for t in tokens)

    def _joined(self, head: str, sign: str, following: str) -> tuple[str, bool, int | None] | None:
        """(word, whether the sign is its own, part with a misread character: 0, 1, 2 for both, else null) of a cut word."""
        m = re.match(r"\s*([^\W\d_][^\s]*)", following)
        if m is None:
            return None
        head = re.split(r"[\s(\"“‘/]", head)[-1].lower().translate(LOOKALIKES)
        tail = m.group(1).lower().strip(_STRIP + ")").rstrip(SIGNS).translate(LOOKALIKES)
        if not tail or not head:
            return None
        f = self.lexicon.frequency
        whole, hyphened = head + tail, f"{head}-{tail}"
        base = re.sub(r"^.*-", "", head) + tail
        if sign in "¬\xad":
            own = False
        elif f(whole) or f(hyphened):
            own = f(hyphened) > f(whole)
        elif f(base):
            own = False
        else:
            clean = [x.translate(DIGITS) for x in (whole, hyphened)]
            near = [self.lexicon.repairs(x, True) if x.replace("-", "").isalpha() else [] for x in clean]
            own = bool(near[1]) and not near[0] or not near[0] and f(re.sub(r"^.*-", "", head)) >= LEAST and f(tail.split("-")[0]) >= LEAST
            if own and sign == "–":
                own = bool(near[1])
        word = hyphened if own else whole
        wrong = None
        if not f(word) and not f(base) and word.isascii() and word.replace("-", "").isalpha() and not (own and f(tail)) and self.word(word, False):
            c = self.lexicon.repairs(word, False)
            c = c[0][1] if c else ""
            at = len(head) + own
            wrong = 1 if c.startswith(word[:at]) else 0 if c and c.endswith(word[at:]) else 2
        return word, own, wrong

    def _layout(self, rows: list[str], titles: list[str]) -> dict[int, str]:
        """Kind of the lines that are no body text: header, page_number, heading, code, number (one of a list)."""
        kinds: dict[int, str] = {}
        keys = [k for t in titles if len(k := letters(t)) >= 4]
        most = sum(sorted((len(t) for t in titles), reverse=True)[:2]) + 24 if titles else 0
        fenced = False
        numbers: list[int] = []
        for k, row in enumerate(rows):
            if row.startswith("```"):
                fenced = not fenced
                kinds[k] = "code"
            elif fenced or row.startswith(("    ", "\t", "def ", "return ")):
                kinds[k] = "code"
            elif row.startswith("#") and _HEADING.match(row):
                kinds[k] = "heading"
            elif len(row) <= 16 and (bare := row.strip()) and _PAGE.fullmatch(bare):
                kinds[k] = "page_number"
                if _BARE.fullmatch(bare):
                    numbers.append(k)
            elif len(row) <= most and keys and is_header(row, keys):
                kinds[k] = "header"
        for run in runs(numbers, kinds):
            first = run[0] - 1
            while first >= 0 and kinds.get(first) == "header":
                first -= 1
            before = rows[first].rstrip() if first >= 0 else ""
            if before.endswith((":", "：")) or len(run) > 2 or len(run) == 2 and first < 0:
                kinds.update((k, "number") for k in run)
        return kinds


def runs(numbers: list[int], kinds: dict[int, str]) -> list[list[int]]:
    """Neighbouring lines of bare numbers; headers between do not part them."""
    out: list[list[int]] = []
    for k in numbers:
        if out and all(kinds.get(j) in ("header", "page_number") for j in range(out[-1][-1] + 1, k)) and k - out[-1][-1] < 4:
            out[-1].append(k)
        else:
            out.append([k])
    return out


_OTHER = re.compile(r"[\W\d_]+")
_LONE = re.compile(r"(?<!\S)[^\sA-Za-z가-힣]*\d[^\sA-Za-z가-힣]*(?!\S)")


def letters(text: str) -> str:
    """Letters of a title or line in one form: numbers out, look-alikes and digits in words as letters."""
    t = _LONE.sub(" ", text).translate(LOOKALIKES).casefold().translate(DIGITS)
    return _OTHER.sub("", t)


@lru_cache(maxsize=4096)
def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[k : k + 3] for k in range(len(text) - 2))


def within(a: str, b: str) -> bool:
    """Whether a line is a title up to an eighth of its letters; an edit spoils at most three trigrams."""
    most = max(1, len(b) // 8)
    if a == b or abs(len(a) - len(b)) > most:
        return a == b
    grams = trigrams(b)
    if sum(a[k : k + 3] in grams for k in range(len(a) - 2)) < len(grams) - 3 * most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


_BARE_LETTERS = {k: None for k in range(128) if not chr(k).isalpha()}


def is_header(row: str, keys: list[str]) -> bool:
    """Whether a line is one of the titles, or two of them, with or without a number, up to a few misread characters."""
    n = len(row.translate(_BARE_LETTERS))  # at most six of a header's letters may show as digits
    parted = _PARTED.search(row.strip()) is not None
    if not parted and not any(k - k // 6 - 7 <= n <= k + k // 6 + 1 or n >= k + 4 for k in map(len, keys)):
        return False
    near = [k for k in keys if len(k) - len(k) // 6 - 7 <= n <= len(k) + len(k) // 6 + 1]
    if near or len(keys) > 1 and any(len(k) + 4 <= n <= 2 * max(map(len, keys)) for k in keys) and _mostly(row, keys):
        line = letters(row)
        if len(line) >= 4:
            if any(within(line, k) for k in near):
                return True
            if any(line == k + j for k in keys if line.startswith(k) for j in keys if j != k):
                return True
    if parted:
        parts = [p for x in _PARTED.split(row) if len(p := letters(x)) >= 4]
        return bool(parts) and all(any(within(p, k) for k in keys) for p in parts)
    return False


_PARTED = re.compile(r"[|–—·•]|\s{2,}")


def _mostly(row: str, keys: list[str]) -> bool:
    """Cheap look at the first letters of a line that could be two titles."""
    start = letters(row[:16])[:3]
    return any(k.startswith(start) for k in keys)


def titles_of(book_id: str | None, title: str | None, text: str) -> list[str]:
    """Running titles a page of the record may carry: of the book (its id is the slug of its title), its section, its headings."""
    out = [re.sub(r"-\d{3,}$", "", book_id).replace("-", " ")] if book_id else []
    if title:
        out.append(title)
    if "#" in text:
        out += [x.lstrip("#").strip() for x in text.split("\n") if _HEADING.match(x)]
    return list(dict.fromkeys(out))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(_WORD.findall(text.lower()))
        if len(counts) > 500_000:
            yield flush()
    if counts:
        yield flush()


def lexicon(texts: DataFrame, share: float = SHARE) -> dict[str, int]:
    """Words of one text column with their counts over all rows: of at least LEAST uses and the given share of all words."""
    counts = texts.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.length("word") > 1)
    counts = written(counts)  # read twice
    kept = counts.where(F.col("n") >= LEAST)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r["word"]: r["n"] for r in kept.where(F.col("n") >= share * total).toLocalIterator()}


_readers: dict[int, Reader] = {}


def _reader(counts: dict[str, int]) -> Reader:
    """The reader of a broadcast lexicon, kept while the worker lives."""
    if id(counts) not in _readers:
        _readers.clear()
        _readers[id(counts)] = Reader(Lexicon(counts))
    return _readers[id(counts)]


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared.value)
        for batch in batches:
            rows = []
            for table, ident, book, title, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(table, ident, k + 1, kind) for k, kind in sorted({(k, kind) for k, kind, _ in reader.lines(text, titles_of(book, title, text))})]
            a, b, c, d = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int32()), pa.array(d, pa.string())], names=["record_table", "record_id", "line_no", "kind"])

    return run


def _inputs(records: DataFrame) -> DataFrame:
    return records.select("record_table", "record_id", "book_id", "title", "text").where("record_id is not null and text is not null")


def find_noise(records: DataFrame) -> DataFrame:
    """record_table, record_id, line_no, kind of every line with noise; a line may have several kinds.

    records: record_table, record_id, book_id, title (of the book or section, may be null), text. Rows with a
    null id or text have no lines. Rows repeated exactly count once in the result. Other columns are ignored,
    an empty table gives no rows, a text is always read whole. Kinds: hyphen, header, page_number, misread.
    """
    rows = _inputs(records)
    shared = records.sparkSession.sparkContext.broadcast(lexicon(rows.select("text")))
    return rows.mapInArrow(_find(shared), "record_table string, record_id string, line_no int, kind string").distinct()


def _pairs(shared):
    """Partial counts of neighbouring lexicon words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value, Counter()

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array([a for a, _ in keys], pa.string()), pa.array([b for _, b in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["a", "b", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    w = _WORD.findall(text.lower())
                    counts.update(p for p in zip(w, w[1:]) if p[0] in known and p[1] in known)
            if len(counts) > 500_000:
                yield flush()
        if counts:
            yield flush()

    return run


def word_pairs(texts: DataFrame, words, share: float = PAIR_SHARE) -> dict[tuple[str, str], int]:
    """Counts of neighbouring lexicon words over all rows, of at least the given share: at most 1 / share pairs."""
    counts = texts.mapInArrow(_pairs(words), "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = written(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {(r["a"], r["b"]): r["n"] for r in counts.where(F.col("n") >= max(LEAST, share * total)).toLocalIterator()}


def choose(reader: Reader, pairs: dict[tuple[str, str], int], word: str, before: str, after: str) -> str:
    """The repair of a word: cheap edits, frequent words and pairs seen next to its neighbours are preferred."""
    lost = word.replace("�", "")
    plain = lost.translate(LOOKALIKES).translate(DIGITS)
    found = [(0.1, plain)] if reader.lexicon.frequency(plain) else []
    if lost != word:
        found += [(0.3, c) for c in reader.lexicon.deletes.get(lost, ()) if re.fullmatch(re.escape(word).replace(re.escape("�"), ".{1,3}"), c)]
    for w in {plain, lost} if plain and plain.isalpha() else ():
        found += reader.lexicon.repairs(w)
    if not found:
        return plain if plain.isalpha() and lost == word else word
    f, p = reader.lexicon.frequency, pairs.get
    return max(found, key=lambda x: (-4 * x[0] + 0.5 * math.log1p(f(x[1])) + math.log1p(p((before, x[1]), 0)) + math.log1p(p((x[1], after), 0)), x[1]))[1]


def repair_text(reader: Reader, pairs: dict[tuple[str, str], int], text: str, titles: list[str]) -> str:
    """The text as paragraphs: running lines gone, cut words joined, misread words replaced, wrapped lines joined."""
    noise = reader.lines(text, titles)
    rows = text.split("\n")
    kinds = reader._layout(rows, titles)
    joins = {k: word for k, kind, word in noise if kind == "hyphen"}
    wrong: dict[int, set[str]] = defaultdict(set)
    for k, kind, tokens in noise:
        if kind == "misread":
            wrong[k].update(t for t in tokens.split("\0") if t)
    out: list[str] = []
    part: list[str] = []
    cut = ""

    def close() -> None:
        if part:
            out.append(" ".join(part))
            part.clear()

    for k, row in enumerate(rows):
        kind = kinds.get(k)
        if kind in ("header", "page_number"):
            continue
        if kind or not row.strip():
            if cut and not kind:
                continue  # a blank line inside a cut word
            close()
            out.append(row)
            continue
        tokens = row.split()
        for j, t in enumerate(tokens):
            if t in wrong[k]:
                core = GLYPH.sub("", t).strip(_STRIP + "!") or ""
                near = [tokens[x].strip(_STRIP).lower() if 0 <= x < len(tokens) else "" for x in (j - 1, j + 1)]
                new = choose(reader, pairs, core.lower(), *near) if core else ""
                new = new.capitalize() if core[:1].isupper() or core[:1] in "01!5" and j == 0 and not part else new
                tokens[j] = t.replace(core, new, 1) if core and not GLYPH.search(t) else new
        tokens = [t for t in tokens if t]
        if cut and tokens:
            tokens[0], cut = cut + tokens[0], ""
        if k in joins and tokens:
            cut = tokens.pop().rstrip(SIGNS + " ")
        if tokens and part and part[-1].endswith("-") and not part[-1].endswith(" -"):
            part[-1] += tokens.pop(0)
        if tokens:
            if _ITEM.match(row):
                close()
            part.append(" ".join(tokens))
    if cut:
        part.append(cut)
    close()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


_ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+")


def _repair(words, pairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(words.value)
        for batch in batches:
            table, ident, book, title, text = (c.to_pylist() for c in batch.columns)
            fixed = [repair_text(reader, pairs.value, t, titles_of(b, h, t)) for b, h, t in zip(book, title, text)]
            yield pa.RecordBatch.from_arrays([pa.array(table, pa.string()), pa.array(ident, pa.string()), pa.array(fixed, pa.string())], names=["record_table", "record_id", "text"])

    return run


def repair_noise(records: DataFrame) -> DataFrame:
    """record_table, record_id, text with each text repaired; inputs and their treatment are those of find_noise.

    Exact repeats of a row give one row. Headings, code and lists of numbers stay as they are.
    """
    rows = _inputs(records)
    context = records.sparkSession.sparkContext
    words = context.broadcast(lexicon(rows.select("text")))
    pairs = context.broadcast(word_pairs(rows.select("text"), words))
    return rows.mapInArrow(_repair(words, pairs), "record_table string, record_id string, text string").distinct()
