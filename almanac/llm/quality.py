"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are binned at quantiles of a training sample. Shallow trees are boosted in turn, one
feature after the other, and each adds to that feature's lookup table; then the pairs of features
whose residuals interact most get two-dimensional tables the same way. A score is the logistic
function of the sum of table entries.

The model is fitted on at most about ``SAMPLE_ROWS`` labelled rows, chosen by a hash of doc_id, so that the
driver holds a bounded matrix, one row per doc_id (of several texts the least features); every text is scored. The longest
word counts as 200 characters at most and the mean line as 2,000, being features of form, not of length. Neither label, lang, source nor doc_id is a feature.

Defined cases: null and empty texts have all features 0 and a score like any other; labels that are null are not
learned from, and of several labels of a document the greatest counts; repeated rows are scored each;
without labels of both kinds every score is the share of label 1, held within 0.001 and 0.999, or 0.5 without labels; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import crc_mod, cut, in_small_batches

SAMPLE_ROWS = 40_000
THRESHOLD = 0.3
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 6
RATE, PENALTY = 0.15, 5.0

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digits", "spaces", "lines", "commas_stops", "marks", "symbols", "bars", "other_bytes",
    "distinct_words", "repeated_neighbours", "repeated_lines", "capital_words", "marked_words", "longest_word", "line_length", "entropy", "short_words",
)

_CLASSES = np.zeros((256, 9), bool)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b",.;:", b"!?", b"*&$#%@^~_=<>{}[]\\/+", b"|")):
    _CLASSES[list(_chars), _i] = True
_CLASSES[128:, 8] = True
_MARKED = re.compile(r"[*&$#%!|]{2,}|\|")


def features(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    share = (counts @ _CLASSES) / n
    p = counts[counts > 0] / n
    words, lines = text.split(), text.split("\n")
    k, m = max(len(words), 1), len(lines)
    sizes = list(map(len, words)) or [0]
    return [
        np.log1p(n), np.log1p(len(words)), sum(sizes) / k, *share.tolist(),
        len(set(words)) / k, sum(a == b for a, b in zip(words, words[1:], strict=False)) / k, 1 - len(set(lines)) / m,
        sum(map(str.isupper, words)) / k, len(_MARKED.findall(text)) / k, min(max(sizes), 200), min(n / m, 2000.0), float(-(p * np.log2(p)).sum()),
        sum(s <= 3 for s in sizes) / k,
    ]


def feature_matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


@dataclass
class Model:
    """Bin edges and lookup tables; ``pairs`` has (feature, feature, coarse edges of both, table)."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for i, j, a, b, table in self.pairs:
            total += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: float, h: float) -> float:
    return RATE * g / (h + PENALTY)


def _gain(g, h):
    return g * g / (h + PENALTY)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Steps of a tree of a few leaves over the bins of one feature, grown by the best split first."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for at, (lo, hi) in enumerate(parts):
            if hi - lo > 1:
                gs, hs = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
                gain = _gain(gs[:-1], hs[:-1]) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1]) - _gain(gs[-1], hs[-1])
                if gain.max() > best[0]:
                    best = (gain.max(), at, lo + int(gain.argmax()) + 1)
        if best[1] is None:
            break
        lo, hi = parts.pop(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    for lo, hi in parts:
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best cross of one cut on each of two features."""
    gs, hs = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    best, out = 0.0, np.zeros_like(g)
    r, c = g.shape
    for i in range(1, r):
        for j in range(1, c):
            boxes = [(0, i, 0, j), (0, i, j, c), (i, r, 0, j), (i, r, j, c)]
            sums = [tuple(v[b, d] - v[a, d] - v[b, e] + v[a, e] for v in (gs, hs)) for a, b, e, d in boxes]
            gain = sum(_gain(*s) for s in sums)
            if gain > best:
                best, out = gain, np.zeros_like(g)
                for (a, b, e, d), s in zip(boxes, sums, strict=True):
                    out[a:b, e:d] = _leaf(*s)
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on a bounded matrix."""
    share = y.mean() if len(y) else 0.5
    if not len(y) or share in (0, 1):
        return Model(float(np.log(min(max(share, 1e-3), 1 - 1e-3) / (1 - min(max(share, 1e-3), 1 - 1e-3)))))
    model = Model(float(np.log(share / (1 - share))), [_edges(c, BINS) for c in x.T])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T, strict=True)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for b, table in zip(binned, model.tables, strict=True):
            g, h = slopes()
            step = _tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
            table += step
            total += step[b]
    coarse = [_edges(c, PAIR_BINS) for c in x.T]
    low = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T, strict=True)]
    shape = [len(e) + 1 for e in coarse]

    def grid(i: int, j: int) -> tuple[float, np.ndarray]:
        g, h = slopes()
        flat = low[i] * shape[j] + low[j]
        return _pair_tree(*(np.bincount(flat, v, shape[i] * shape[j]).reshape(shape[i], shape[j]) for v in (g, h)))

    ranked = sorted(((grid(i, j)[0], i, j) for i in range(len(coarse)) for j in range(i) if shape[i] > 1 and shape[j] > 1), reverse=True)
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((shape[i], shape[j]))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, table in model.pairs:
            step = grid(i, j)[1]
            table += step
            total += step[low[i], low[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled documents whose CRC-32 of doc_id modulo ``folds`` is not ``held``."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    known = known.where(crc_mod("doc_id", folds) != held)
    share = rows / max(known.count(), 1)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = cut(known, "sample")  # about ``rows`` rows at most, so broadcast below

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "x": list(feature_matrix(b["text"]))})

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # One row of a doc_id that repeats, whatever its rows: the sample bounds what comes to the driver.
    each = in_small_batches(joined).mapInPandas(run, "doc_id long, quality double, x array<double>").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("x").alias("x"))
    data = each.toPandas().sort_values("doc_id", kind="stable")
    x = np.array(data["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, data["quality"].to_numpy(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": sent.value.scores(feature_matrix(b["text"]))})

    return in_small_batches(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
