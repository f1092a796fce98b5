"""Language identification with interpolated Kneser-Ney character trigram models.

Training counts trigrams of lower-case letters per language in Spark, anything else being one space. From the counts come
the discounted trigram probabilities, the weight that each context leaves to bigrams, and in the same way those of bigrams
and single characters by continuation counts; below them every symbol is as likely as an unseen one. Symbols are whole code
points, three of which fill one 63-bit key, so no letters share a symbol. The arrays of keys are sorted, and a text is
scored by binary search for all its trigrams at once: a trigram that no language has takes each language's weight of its
own context and the bigram below. The language with the lowest cross-entropy per character wins. The arrays grow with the
distinct trigrams of the corpus, which the driver gathers and sends to every task; they are counts, not documents.

Rejection is calibrated on all training texts: a text is rejected if its best cross-entropy lies more than
``REJECT_SIGMAS`` standard deviations above the mean of training texts of that language, with the deviation
widened for short texts, or if it has no letter. The score is the share of the best language's likelihood.

Defined cases: null texts and texts without letters are ``und`` with score 0 and rejected; rows without
``lang`` or ``doc_id`` are not learned from; repeated rows count as often as they appear; equal
scores go to the language that sorts first; without any training row every text is ``und``; texts are read whole at any
length; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import crc_mod, cut, in_small_batches

DISCOUNT = 0.75
REJECT_SIGMAS = 8.0
#: Characters scored or counted together.
GROUP_CHARS = 400_000
SPACE = 32
#: Distinct trigrams of a language that a task sums before it sends them on.
MOST_HELD = 1_000_000

#: Bits of a code point.
BITS = 21
_LAST, _LOW_TWO = (1 << BITS) - 1, (1 << 2 * BITS) - 1

_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """For each code point the symbol of its lower-case letter, or a space."""
    global _fold
    if _fold is None:
        out = np.full(0x110000, SPACE, np.int32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                out[c] = ord(s.lower()[0])
        _fold = out
    return _fold


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram keys of all texts, and how many each text has; a text is framed by spaces, and spaces don't repeat."""
    joined = "".join(f" {t} " for t in texts)
    symbols = fold_table()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    blank = symbols == SPACE
    keep = np.ones(len(symbols), bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | (owner[1:] != owner[:-1])
    symbols, owner = symbols[keep].astype(np.int64), owner[keep]
    keys = symbols[:-2] << 2 * BITS | symbols[1:-1] << BITS | symbols[2:]
    inside = owner[:-2] == owner[2:]
    return keys[inside], np.bincount(owner[:-2][inside], minlength=len(texts))


def grouped(rows: Iterator, size) -> Iterator[list]:
    """Lists of rows of about ``GROUP_CHARS`` characters each."""
    group, chars = [], 0
    for row in rows:
        group.append(row)
        chars += size(row)
        if chars > GROUP_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def count_trigrams(texts: DataFrame) -> DataFrame:
    """(lang, trigram, n) of a table of (text, lang), summed within tasks before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for lang, rows in b.groupby("lang", sort=False):
                for group in grouped(rows["text"], len):
                    keys, n = _summed(trigrams(group)[0])
                    if lang in held:
                        keys, n = _summed(np.concatenate((held[lang][0], keys)), np.concatenate((held[lang][1], n)))
                    held[lang] = keys, n
                    if len(keys) > MOST_HELD:
                        yield pd.DataFrame({"lang": lang, "trigram": keys, "n": n.astype(np.int64)})
                        del held[lang]
        for lang, (keys, n) in held.items():
            yield pd.DataFrame({"lang": lang, "trigram": keys, "n": n.astype(np.int64)})

    counted = texts.where("text is not null and lang is not null").select("text", "lang")
    counted = in_small_batches(counted).mapInPandas(run, "lang string, trigram long, n long")
    return counted.groupBy("lang", "trigram").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """Sorted keys with one column per language; a key that is not there has a default."""

    keys: np.ndarray
    values: np.ndarray
    default: np.ndarray

    def __getitem__(self, wanted: np.ndarray) -> np.ndarray:
        out, found = self.find(wanted)
        out[~found] = self.default
        return out

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.values[at], self.keys[at] == wanted


@dataclass
class Model:
    """Log probabilities of trigrams, and what unseen ones need: weights that contexts leave, bigrams, middles and characters."""

    langs: list[str]
    trigrams: Table
    contexts: Table
    pairs: Table
    middles: Table
    singles: Table
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """Log probabilities, one row per trigram."""
        out, found = self.trigrams.find(keys)
        miss = np.flatnonzero(~found)
        if len(miss):
            key = keys[miss]
            pair = key & _LOW_TWO
            lower, known = self.pairs.find(pair)
            new = pair[~known]
            lower[~known] = self.middles[new >> BITS] * self.singles[new & _LAST]
            out[miss] = np.log(self.contexts[key >> BITS] * lower)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, and the number of characters."""
        keys, n = trigrams(texts)
        total = np.zeros((len(texts), len(self.langs)))
        has = n > 0
        if len(keys):
            starts = np.cumsum(n) - n
            total[has] = np.add.reduceat(self.logs(keys), starts[has], axis=0)
        return -total / np.maximum(n, 1)[:, None], n


def _summed(keys: np.ndarray, amounts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their amounts, or how many there are."""
    values, place = np.unique(keys, return_inverse=True)
    return values, np.bincount(place, amounts, len(values)).astype(float)


def build(counts: pd.DataFrame) -> Model:
    """Interpolated Kneser-Ney models of a table (lang, trigram, n)."""
    langs = sorted(counts["lang"].unique())
    keys = np.unique(counts["trigram"].to_numpy(np.int64))
    pair_keys, single_keys = np.unique(keys & _LOW_TWO), np.unique(keys & _LAST)
    context_keys, middle_keys = np.unique(keys >> BITS), np.unique(pair_keys >> BITS)
    symbols = len(np.unique(np.concatenate((keys & _LAST, keys >> BITS & _LAST, keys >> 2 * BITS)))) + 1  # and one for all unseen ones
    columns: dict[str, list[np.ndarray]] = {name: [] for name in ("trigrams", "contexts", "pairs", "middles", "singles", "other")}

    def spread(wanted: np.ndarray, own: np.ndarray, values: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(wanted), default)
        out[np.searchsorted(wanted, own)] = values
        return out

    for lang in langs:
        own = counts[counts["lang"] == lang]
        tri, n = own["trigram"].to_numpy(np.int64), own["n"].to_numpy(float)
        pairs, before = _summed(tri & _LOW_TWO)  # distinct left neighbours
        singles, ends = _summed(pairs & _LAST)
        # Characters by continuation, interpolated with the uniform distribution.
        rest = DISCOUNT * len(singles) / ends.sum()
        p1 = spread(single_keys, singles, np.maximum(ends - DISCOUNT, 0) / ends.sum(), 0.0) + rest / symbols
        columns["singles"].append(p1)
        columns["other"].append(rest / symbols)
        # Bigrams by continuation.
        middles, total = _summed(pairs >> BITS, before)
        _, types = _summed(pairs >> BITS)
        left = spread(middle_keys, middles, DISCOUNT * types / total, 1.0)
        columns["middles"].append(left)
        totals = spread(middle_keys, middles, total, 1.0)
        middle = np.searchsorted(middle_keys, pair_keys >> BITS)
        known = np.maximum(spread(pair_keys, pairs, before, 0.0) - DISCOUNT, 0)
        p2 = known / totals[middle] + left[middle] * p1[np.searchsorted(single_keys, pair_keys & _LAST)]
        columns["pairs"].append(p2)
        # Trigrams by counts.
        contexts, total = _summed(tri >> BITS, n)
        _, types = _summed(tri >> BITS)
        left = spread(context_keys, contexts, DISCOUNT * types / total, 1.0)
        columns["contexts"].append(left)
        totals = spread(context_keys, contexts, total, 1.0)
        context = np.searchsorted(context_keys, keys >> BITS)
        known = np.maximum(spread(keys, tri, n, 0.0) - DISCOUNT, 0)
        columns["trigrams"].append(np.log(known / totals[context] + left[context] * p2[np.searchsorted(pair_keys, keys & _LOW_TWO)]))
    there = {name: np.array(c).T.copy() for name, c in columns.items() if name != "other"}
    one = np.ones(len(langs))
    return Model(
        langs,
        Table(keys, there["trigrams"], one),
        Table(context_keys, there["contexts"], one),
        Table(pair_keys, there["pairs"], one),
        Table(middle_keys, there["middles"], one),
        Table(single_keys, there["singles"], np.array(columns["other"])),
    )


def fit(docs: DataFrame, learn: Column) -> Model | None:
    """Models of the rows where ``learn`` holds: counted over all of them, then calibrated on all of them."""
    training = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = cut(count_trigrams(training), "trigrams").toPandas()
    if not len(counts):
        return None
    model = build(counts)
    model.mean, model.deviation = np.full(len(model.langs), np.inf), np.ones(len(model.langs))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            known = [(t, x) for t, x in zip(b["text"], b["lang"], strict=True) if x in m.langs]  # a language whose texts hold no letter has no model
            for rows in grouped(known, lambda r: len(r[0])):
                if not rows:
                    continue
                h, n = m.entropies([t for t, _ in rows])
                own = h[np.arange(len(rows)), [m.langs.index(x) for _, x in rows]]
                out = pd.DataFrame({"lang": [x for _, x in rows], "w": n, "h": own * n, "hh": own * own * n})
                yield out.groupby("lang", as_index=False).sum()

    sums = in_small_batches(training).mapInPandas(run, "lang string, w double, h double, hh double").groupBy("lang").agg(F.sum("w").alias("w"), F.sum("h").alias("h"), F.sum("hh").alias("hh"))
    for r in sums.collect():  # a row per language
        if r.w:
            i = model.langs.index(r.lang)
            model.mean[i] = r.h / r.w
            model.deviation[i] = max(r.hh / r.w - model.mean[i] ** 2, 1e-4) ** 0.5
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            for rows in grouped(zip(b["doc_id"], b["text"], strict=True), lambda r: len(r[1] or "")):
                ids = pd.array([i for i, _ in rows], "Int64") if b["doc_id"].isna().any() else [i for i, _ in rows]
                if m is None:
                    yield pd.DataFrame({"doc_id": ids, "lang_pred": "und", "score": 0.0, "cross_entropy": None, "rejected": True})
                    continue
                texts = [t or "" for _, t in rows]
                h, n = m.entropies(texts)
                best = h.argmin(axis=1)
                low = h[np.arange(len(rows)), best]
                weight = np.exp(-(h - low[:, None]) * n[:, None])
                letters = n > 0
                spread = m.deviation[best] + 2.0 / np.sqrt(np.maximum(n, 1))
                yield pd.DataFrame(
                    {
                        "doc_id": ids,
                        "lang_pred": np.where(letters, np.array(m.langs, object)[best], "und"),
                        "score": np.where(letters, 1 / weight.sum(axis=1), 0.0),
                        "cross_entropy": np.where(letters, low, np.nan),
                        "rejected": ~letters | (low > m.mean[best] + REJECT_SIGMAS * spread),
                    }
                )

    return in_small_batches(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learn from documents whose CRC-32 of doc_id modulo ``folds`` is not ``held``; predict all of them."""
    docs = docs.select("doc_id", "text", "lang")
    learn = F.coalesce(crc_mod("doc_id", folds) != held, F.lit(False))
    return predict(docs, fit(docs, learn)).withColumn("held_out", F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected, all columns kept, in one pass after training."""
    model = fit(docs.select("doc_id", "text", "lang"), F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        m = sent.value
        out = []
        for group in grouped((t or "" for t in texts), len):
            if m is None:
                out.append(np.ones(len(group), bool))
                continue
            h, n = m.entropies(group)
            best = h.argmin(axis=1)
            low = h[np.arange(len(group)), best]
            out.append((n == 0) | (low > m.mean[best] + REJECT_SIGMAS * (m.deviation[best] + 2.0 / np.sqrt(np.maximum(n, 1)))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    return in_small_batches(docs).where(~rejected(F.col("text")))
