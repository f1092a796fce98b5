"""Secret scans: base patterns, and credential values judged by the cost of guessing them.

Next to the base patterns, every value in a credential context (a name such as ``pwd`` or ``private key``,
then a separator; letters, digits and underscores may stand before the name), whether a base span holds it or not, is split
by dynamic programming into the cheapest sequence of words, dates, repeats, keyboard walks and brute-force characters.
The cost of a sequence is the sum of the log10 guesses of its parts plus the log10 of the factorial of their number. A value
that takes at least ``MIN_LOG10_GUESSES`` to guess is a secret and a span of kind ``guess``; a cheaper one, such as ``changeme``, is a placeholder.
Costs are exact below ``MOST_LOG10_GUESSES`` and reported as that beyond it, so states that cost more are not followed and
the work on a value grows with its length alone.

Words are ranked: first the usual ones of passwords, then those of the corpus that most texts hold, ``DICTIONARY`` at most, ties by
code point. Texts are counted without credential values and runs of hex digits, copies of a text once, and a word must stand
in ``LEAST_TEXTS`` of them and a share of ``LEAST_SHARE``, so no secret becomes a word by being in the corpus, however often. A word
beyond these bounds costs what its characters cost.

Defined cases: null and empty texts have no spans; repeated rows are scanned each by itself; spans of one
start follow the order of ``KINDS``; texts and values are scanned whole at any length; an empty table gives an
empty table; other columns are not read by ``scan`` and are kept by ``redact``.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator, Mapping
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import checked_join, cut, in_small_batches

KINDS = ("assign", "access", "hex", "guess")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
MIN_LOG10_GUESSES = 8.0
#: Where reported costs end; no value is less or more of a secret for it.
MOST_LOG10_GUESSES = 32.0
#: Words taken from the corpus, and their letters at most.
DICTIONARY, LONGEST_WORD = 20_000, 24
#: Texts, and share of all different texts, that hold a word of the corpus at least.
LEAST_TEXTS, LEAST_SHARE = 3, 1e-4
#: Of a walk longer than twice this, only ends this near to its start or end are tried: no cheaper sequence leaves it in between.
WALK_ENDS = 64

_FLAGS = re.ASCII | re.IGNORECASE
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs of hex digits are maximal, so asking for the least length at once finds the same matches.
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|api[ _-]?key|(?:access|private|secret)[ _-]?key)\b["']?\x20*(?::=|=>|[:=])\x20*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;<>]+))""",
    _FLAGS,
)
_HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "key")

#: Usual words of passwords, commonest first; the rank of a word is the guesses it takes.
WORDS = (
    "password secret admin letmein welcome monkey dragon master login hello qwerty sunshine princess football shadow superman "
    "iloveyou trustno test testing example sample changeme change placeholder default user guest root pass token key api your "
    "my the none null empty todo redacted hidden dummy fake value string here foo bar baz hunter summer winter spring autumn "
    "company server database service account access private public love baby angel star blue red green black white"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LEET = str.maketrans("013457@$!", "oieastasi")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEXT_TO = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {b + a for row in ROWS for a, b in zip(row, row[1:], strict=False)}
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
#: By number of parts, as many as may cost less than is reported.
LOG10_FACTORIAL = [math.log10(math.factorial(k)) for k in range(int(MOST_LOG10_GUESSES / math.log10(2)) + 2)]
# log10 of the dates of 200 years, and of the years alone.
DATE_COST, YEAR_COST = math.log10(73_000), math.log10(200)


def _class_size(value: str) -> float:
    size = 0
    for test, n in ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10)):
        size += n * any(map(test, value))
    return size + 33 * any(not c.isalnum() for c in value) or 36


class Repeats:
    """Runs of repeated units up to a length, found by start."""

    def __init__(self, value: str, longest: int):
        code = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(value)
        #: By unit: the places whose character is not the one a unit later.
        self.differs = [np.flatnonzero(code[:-unit] != code[unit:]) for unit in range(1, min(longest, self.n // 2) + 1)]

    def at(self, start: int) -> Iterator[tuple[int, int]]:
        """(unit, times) of the run of each unit from ``start``, twice at least; no unit that repeats a smaller one."""
        found: list[tuple[int, int]] = []
        for unit, differs in enumerate(self.differs, 1):
            k = np.searchsorted(differs, start)
            end = int(differs[k]) + unit if k < len(differs) else self.n
            if end - start >= 2 * unit and not any(unit % u == 0 and start + unit <= e for u, e in found):
                found.append((unit, end))
                yield unit, (end - start) // unit


def guess_cost(value: str, rank: Mapping[str, int] = RANK) -> float:
    """Least log10 guesses over all segmentations of ``value``, ``MOST_LOG10_GUESSES`` at most."""
    return segment(value, rank)[0]


def parts_at(value: str, low: str, plain: str, runs: Repeats, i: int, per_char: float, rank: Mapping[str, int]) -> Iterator[tuple[int, str, float]]:
    """(end, kind, log10 guesses) of the words, repeats, walks and dates that start at ``i``."""
    n = len(value)
    for unit, times in runs.at(i):
        for k in range(max(2, times - LONGEST_WORD // unit), times + 1):  # the last ones may belong to a word
            if unit * k >= 3:
                yield i + unit * k, "repeat", unit * per_char + math.log10(k)
    for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
        word, swapped = low[i:j], plain[i:j]
        own, other = rank.get(word), rank.get(swapped)
        if own is not None or other is not None:
            changed = (own is None) + (value[i:j] != value[i:j].lower())
            yield j, "word", math.log10((own if own is not None else other) + 1) + changed * math.log10(2 * (j - i))
    j = i + 1
    while j < n and (low[j - 1 : j + 1] in NEXT_TO or ord(low[j]) - ord(low[j - 1]) == 1):
        j += 1
    for end in chain(range(i + 3, min(j, i + WALK_ENDS) + 1), range(max(i + WALK_ENDS + 1, j - WALK_ENDS), j + 1)):
        yield end, "walk", math.log10(47 * 4) + math.log10(end - i)
    if (m := DATE.match(value, i)) is not None:
        yield m.end(), "date", YEAR_COST if m.end() - i == 4 else DATE_COST


def segment(value: str, rank: Mapping[str, int] = RANK) -> tuple[float, list[tuple[str, str]]]:
    """Least log10 guesses, and the (kind, part) sequence that has it; equal costs keep fewer, earlier parts.

    Brute-force characters beside each other form one span. A value beyond ``MOST_LOG10_GUESSES`` has no sequence.
    """
    n = len(value)
    if not n:
        return 0.0, []
    per_char = math.log10(_class_size(value))
    low = value.lower() if len(value.lower()) == n else value  # a few letters change their number in lower case
    plain = low.translate(LEET)
    runs = Repeats(value, int(MOST_LOG10_GUESSES / per_char))
    # State: position, number of parts, whether a brute-force span is open; positions are taken in order, as every part moves on.
    best: dict[int, dict[tuple[int, bool], tuple[float, tuple | None]]] = {0: {(0, False): (0.0, None)}}
    queue = [0]
    while queue:
        i = heapq.heappop(queue)
        if i == n:
            break
        parts = list(parts_at(value, low, plain, runs, i, per_char, rank))
        for (k, is_open), (cost, _) in sorted(best[i].items()):
            steps = [(i + 1, "brute", per_char, True, k if is_open else k + 1)]
            steps += [(end, kind, more, False, k + 1) for end, kind, more in parts]
            for end, kind, more, still, count in steps:
                total = cost + more
                if total + LOG10_FACTORIAL[count] >= MOST_LOG10_GUESSES:
                    continue
                if end not in best:
                    best[end] = {}
                    heapq.heappush(queue, end)
                there = best[end]
                if (count, still) not in there or total < there[count, still][0] - 1e-12:
                    there[count, still] = (total, (i, k, is_open, kind))
    if n not in best:
        return MOST_LOG10_GUESSES, []
    total, k, is_open = min((cost + LOG10_FACTORIAL[k], k, o) for (k, o), (cost, _) in best[n].items())
    found, at = [], n
    while (back := best[at][k, is_open][1]) is not None:
        start, k, is_open, kind = back
        if kind == "brute" and found and found[-1][0] == "brute":
            found[-1] = ("brute", value[start:at] + found[-1][1])
        else:
            found.append((kind, value[start:at]))
        at = start
    return total, found[::-1]


def find(text: str | None, rank: Mapping[str, int] = RANK) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, log10 guesses or 0) of all spans of a text, by start, then kind."""
    if not text:
        return []
    spans = [(m.start(), m.end(), 2, 0.0) for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1, 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    low = text.lower()
    if any(h in low for h in _HINTS):
        spans += [(m.start(), m.end(), 0, 0.0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
        for m in CONTEXT.finditer(text):
            start, end = m.span(m.lastindex)
            cost = guess_cost(text[start:end], rank)
            if cost >= MIN_LOG10_GUESSES:
                spans.append((start, end, 3, cost))
    return [(s, e, KINDS[k], c) for s, e, k, c in sorted(spans, key=lambda x: (x[0], x[2]))]


def listed(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind, *_ in spans)


#: What is taken out of a text before its words are counted.
UNCOUNTED = f"(?i:{CONTEXT.pattern})|(?i:{ASSIGN.pattern})"


def prose(text: Column) -> Column:
    """A text without credential values and runs of hex digits."""
    low = F.lower(text)
    hinted = F.greatest(*[F.contains(low, F.lit(h)) for h in _HINTS])
    return F.regexp_replace(F.when(hinted, F.regexp_replace(text, UNCOUNTED, " ")).otherwise(text), HEX.pattern, " ")


def different_texts(docs: DataFrame) -> DataFrame:
    """The texts of (doc_id, text), of equal ones that of the least doc_id. Digests of copies alone are joined, behind a count."""
    rows = docs.where("text is not null").select("doc_id", "text", F.unhex(F.md5("text")).alias("digest"))
    copied = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("digest", "first")
    rows = checked_join(rows, cut(copied, "copied"), "digest", "left")
    return rows.where("first is null or doc_id = first").select("text")


def dictionary(docs: DataFrame, size: int = DICTIONARY, least_texts: int = LEAST_TEXTS, least_share: float = LEAST_SHARE) -> dict[str, int]:
    """Ranks of the fixed words and of the corpus words that most different texts hold, ``size`` at most.

    Frequencies are taken in steps of a hundredth, and words of one step are in or out together; so a histogram of
    the steps gives the least frequency, and no more than ``size`` words come to the driver.
    """
    texts = different_texts(docs)
    words = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.lower(prose(F.col("text"))), F.lit(f"[a-z]{{3,{LONGEST_WORD}}}"), F.lit(0))))
    counted = texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))  # the empty word counts the texts
    counted = cut(counted.withColumn("step", F.floor(F.log("n") * 100).cast("int")), "words")
    total = counted.where("word = ''").first()
    enough = max(least_texts, math.ceil(least_share * (total.n if total else 0)))
    counted = counted.where((F.col("word") != "") & (F.col("n") >= enough))
    least, left = None, size
    for r in sorted(counted.groupBy("step").count().collect(), reverse=True):  # some thousand steps at most
        if r["count"] > left:
            break
        least, left = r.step, left - r["count"]
    rank = dict(RANK)
    for r in counted.where(F.lit(False) if least is None else F.col("step") >= least).orderBy(F.desc("n"), "word").collect():
        rank.setdefault(r.word, len(rank) + 1)
    return rank


def scan(docs: DataFrame, rank: Mapping[str, int] | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_guess, base (list as text), spans, max_log10_guesses.

    ``rank`` are ranks of words; those of the corpus and the fixed ones unless it is given.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dictionary(docs) if rank is None else rank)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                found = find(text, sent.value)
                kinds = [x[2] for x in found]
                base = [x for x in found if x[2] != "guess"]
                rows.append((*(kinds.count(k) for k in KINDS), listed(base), listed(found), max((x[3] for x in found if x[3]), default=None)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base", "spans", "max_log10_guesses"])
            out["max_log10_guesses"] = out["max_log10_guesses"].astype(float)
            out.insert(0, "doc_id", b["doc_id"].array)
            yield out

    return in_small_batches(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base string, spans string, max_log10_guesses double")


def redact_text(text: str | None, rank: Mapping[str, int] = RANK) -> str | None:
    """The text with every secret replaced by a mark of its kind; spans that overlap share one mark."""
    spans = find(text, rank)
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            out += [text[at:start], f"[SECRET-{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, rank: Mapping[str, int] | None = None) -> DataFrame:
    """The documents with secrets replaced in ``text``; ``n_chars``, if there, follows. All rows stay."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionary(docs) if rank is None else rank)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact_text(t, sent.value))

    out = in_small_batches(docs).withColumn("text", clean(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
