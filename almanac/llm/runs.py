"""Periodic runs of words, found with a dictionary of basic factors.

For each power of two L every stretch of L words of a document gets a name, equal stretches the same one; the names of
length 2 L come from pairs of names. A run of period q, L <= q < 2 L, holds its first L words again q words later. Names
that don't recur in their document are dropped on the way, so ordinary prose is left after a few levels.

Successive occurrences of a name lie in arithmetic progressions: gaps of at most L / 2 all equal the period of the
stretch itself, and at most three wider gaps fit into 2 L words. So all distances below 2 L that are no multiple of the
small gap are a sum of one to three neighbouring wide gaps and some of the small ones beside them: these are the
proposed periods, about as many as there are occurrences. Each is extended to both sides by the names, from long to
short; runs found with several periods keep the smallest.

Work is by batches of documents, one document stays whole in a task; memory is a few integers per word and level of
that batch.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; rows that repeat a doc_id are
taken each for itself; a null doc_id is allowed; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import in_small_batches

#: Words of documents that are searched together; a longer document is searched alone.
GROUP_WORDS = 1_000_000
LEAST = 12

RUNS = "array<struct<start: long, length: long, period: long>>"


class Factors:
    """Names of all stretches of 1, 2, 4, ... words that occur twice in their document; -1 for the others."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        n, ends = len(codes), np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.begin, self.stop = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        self.levels: list[np.ndarray] = []
        places, keys, length = np.arange(n), owner * (int(codes.max(initial=0)) + 1) + codes, 1
        most = int(sizes.max(initial=0))
        while len(places):
            _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
            again = counts[names] > 1
            places, names = places[again], (np.cumsum(counts > 1) - 1)[names[again]]
            if not len(places):
                break
            level = np.full(n, -1, np.int32)
            level[places] = names
            self.levels.append(level)
            if 2 * length > most:
                break
            fits = places[places + 2 * length <= self.stop[places]]
            fits = fits[level[fits + length] >= 0]
            keys, places, length = level[fits].astype(np.int64) * (int(names.max()) + 1) + level[fits + length], fits, 2 * length

    def proposals(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and periods from L up to, not including, 2 L, L = 2 ** k, proposed by successors of equal names."""
        level, length = self.levels[k], 1 << k
        at = np.flatnonzero(level >= 0)
        at = at[np.argsort(level[at], kind="stable")]
        far = 4 * length + 4 * len(level)
        gap = np.where(level[at[1:]] == level[at[:-1]], at[1:] - at[:-1], far)
        gap = np.concatenate(([far], gap, [far]))  # gap[t] lies before the t-th occurrence
        small = gap <= length // 2
        place = np.arange(len(gap))
        before = np.maximum.accumulate(np.where(small, -1, place))  # the last wide gap up to here
        after = np.minimum.accumulate(np.where(small, len(gap), place)[::-1])[::-1]
        first = np.flatnonzero(~small & (gap < 2 * length))
        last, starts, periods = first.copy(), [], []
        for _ in range(3):
            base = at[last] - at[first - 1]
            keep = base < 2 * length
            first, last, base = first[keep], last[keep], base[keep]
            if not len(first):
                break
            left, right = first - 1 - before[first - 1], after[last + 1] - last - 1
            step = np.where(left > 0, gap[first - 1], np.where(right > 0, gap[last + 1], 1))
            more = np.minimum(left + right, (2 * length - 1 - base) // step)
            which = np.repeat(np.arange(len(first)), more + 1)
            extra = np.arange(len(which)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
            period = base[which] + extra * step[which]
            wanted = period >= length
            which, extra = which[wanted], extra[wanted]
            starts.append(at[first[which] - 1] - np.minimum(extra, left[which]) * step[which])
            periods.append(period[wanted])
            following = after[last + 1]
            goes_on = gap[following] < 2 * length
            first, last = first[goes_on], following[goes_on]
        return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def extended(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words on (or back) from places a and b are equal."""
        moved = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, length = self.levels[k], 1 << k
            live = np.arange(len(a))
            while len(live):
                if back:
                    x, y = a[live] - moved[live] - length, b[live] - moved[live] - length
                    inside = x >= self.begin[np.minimum(a[live], len(level) - 1)]
                else:
                    x, y = a[live] + moved[live], b[live] + moved[live]
                    inside = y + length <= self.stop[a[live]]
                live, x, y = live[inside], x[inside], y[inside]
                equal = (level[x] == level[y]) & (level[x] >= 0)
                live = live[equal]
                moved[live] += length
        return moved


def find_runs(codes: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of at least ``max(least, 2 * period)`` words, in order of start, then period.

    ``codes`` are the words of documents under one another, ``sizes`` the documents' numbers of words.
    """
    factors = Factors(codes, sizes)
    found = [factors.proposals(k) for k in range(len(factors.levels))]
    none = np.zeros(0, np.int64)
    if not found:
        return none, none, none
    place, period = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    place, period = np.divmod(np.unique(place * (len(codes) + 1) + period), len(codes) + 1)
    start = place - factors.extended(place, place + period, back=True)
    end = place + period + factors.extended(place, place + period)
    long = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)  # of one stretch the smallest period
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where the words of a tenth of the documents are replaced by a repetition, and its period; None for the others."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % n
    return (a, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


def runs(docs: DataFrame, change: Callable[[int | None, int], tuple[int, int] | None] | None = None, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of whole texts: the runs in order of start, then period, and the words joined by a space, what repeats in a run left out.

    ``change`` may name, for a doc_id and a number of words, a place a and a period p: from a on words are then taken from a + (i - a) % p.
    """

    most = GROUP_WORDS

    def group(ids: list, texts: list) -> pa.RecordBatch:
        words = [(t or "").encode().split() for t in texts]
        for k, (i, w) in enumerate(zip(ids, words, strict=True)):
            if change is not None and (at := change(i, len(w))):
                a, p = at
                again = w[a : a + p]
                w[a:] = (again * (-(-(len(w) - a) // max(1, len(again)))))[: len(w) - a]
            words[k] = w
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.empty(int(sizes.sum()), object)
        flat[:] = [x for w in words for x in w]
        codes = pd.factorize(flat)[0] if len(flat) else np.zeros(0, np.int64)
        start, end, period = find_runs(codes.astype(np.int64), sizes, least)
        change_at = np.bincount(start + period, minlength=len(flat) + 1) - np.bincount(end, minlength=len(flat) + 1)
        gone = np.cumsum(change_at)[:-1] > 0
        ends = np.cumsum(sizes)
        begin = ends - sizes
        cuts = np.searchsorted(start, np.append(begin, len(flat)))
        cuts[-1] = len(start)
        touched = np.flatnonzero(cuts[1:] > cuts[:-1])
        for k in touched.tolist():
            words[k] = flat[begin[k] : ends[k]][~gone[begin[k] : ends[k]]].tolist()
        own = np.repeat(begin, cuts[1:] - cuts[:-1])
        structs = pa.StructArray.from_arrays([pa.array(start - own), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), structs)
        collapsed = pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), lists, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, held = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                size = len(t or "") // 5
                if ids and held + size > most:
                    yield group(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(t)
                held += size
            if ids:
                yield group(ids, texts)

    return in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """Of the result of ``runs``: the number of runs, the longest (ties: first, then smallest period), and digests of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("(-best.l * 1000) div best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
