"""Phrase collocations from sorted streams of n-gram counts.

Tasks number the words of their texts in byte order and count n-grams by sorting, so that each gives a stream of
phrases with counts in prefix order; Spark adds the streams up, and the phrases with enough occurrences are written, a
table per order. The tables are then read in two orders and joined by merging sorted streams. In prefix order a phrase meets the
counts of its first words and of the longer phrases that begin with it, in suffix order those of its last words and of the
phrases that end with it.

An n-gram can only be frequent if the shorter ones inside are. So orders 1, 2 and 3 with 4 are counted in turn, and a task
leaves out n-grams that hold a rare one. It asks a bitmap of fixed size in which all frequent shorter phrases are
marked; one marked by chance costs a row and changes no count, as sums are compared with the least count in the end.

Defined cases: null and empty texts have no words; a null language is ``und``; rows that repeat a document count each; a
language without enough phrases has fewer rows, or none; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import cut, in_small_batches

#: Bits of the map of frequent phrases, a power of two: 8 MB whatever the corpus.
MAP_BITS = 1 << 26
#: Bytes of text that a task counts together; its words take some fifteen times as much memory.
GROUP_BYTES = 12 << 20
LEAST, TOP, LONGEST = 30, 2000, 4
#: A phrase that holds a shorter one gets it dropped from this share of its occurrences, in hundredths.
ABSORBS = 80

SEPARATOR = b"\xff"  # no byte of UTF-8
#: Ends of pieces become separators; of white space, only space and tab lie between words.
PIECES = bytes.maketrans(b".,;:!?\n\v\f\r", SEPARATOR * 10)


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in byte order, and all words as numbers into them; -1 between pieces."""
    data = (b" " + SEPARATOR + b" ").join(texts).lower().translate(PIECES).replace(SEPARATOR, b" " + SEPARATOR + b" ")
    tokens = data.split()
    flat = np.empty(len(tokens), object)
    flat[:] = tokens
    del data, tokens
    codes, found = pd.factorize(flat)
    order = sorted(range(len(found)), key=found.__getitem__)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    if order and found[order[-1]] == SEPARATOR:  # the greatest of all words
        rank[order[-1]] = -1
        order.pop()
    return pa.array([found[i] for i in order], pa.binary()), rank[codes]


def _marked(lang: bytes, phrases: pa.Array, bitmap: np.ndarray) -> np.ndarray:
    at = zlib.crc32(lang + b"\n")
    bits = np.fromiter((zlib.crc32(p, at) for p in phrases.to_pylist()), np.int64, len(phrases)) & (8 * len(bitmap) - 1)
    return (bitmap[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1


def _joined(vocabulary: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    parts = [vocabulary.take(pa.array(c)) for c in columns]
    return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))


def _counted(lang: bytes, texts: list[bytes], orders: tuple[int, ...], bitmap: np.ndarray | None) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(n, phrases, counts) of texts of a language, phrases in byte order of their words; order 0 is the number of words."""
    vocabulary, words = _words(texts)
    n_words, size = int((words >= 0).sum()), len(vocabulary)
    if not n_words:
        return
    if 0 in orders:
        yield 0, pa.array([b""], pa.binary()), np.array([n_words])
    if 1 in orders:
        yield 1, vocabulary, np.bincount(words[words >= 0], minlength=size)
        return
    good = words >= 0
    if orders == (2,):
        marked = _marked(lang, vocabulary, bitmap)
        good &= marked[words]
    pair = good[:-1] & good[1:]
    key = words[:-1] * size + words[1:]
    distinct, pairs, counts = np.unique(key[pair], return_inverse=True, return_counts=True)
    if not len(distinct):
        return
    if orders == (2,):
        yield 2, _joined(vocabulary, [distinct // size, distinct % size]), counts
        return
    # Numbers of pairs that may be frequent, in prefix order; longer phrases are rows of such numbers.
    marked = _marked(lang, _joined(vocabulary, [distinct // size, distinct % size]), bitmap)
    at = np.full(len(words), -1, np.int64)
    at[:-1][pair] = np.where(marked, np.cumsum(marked) - 1, -1)[pairs]
    distinct = distinct[marked]
    heads, key = np.stack((distinct // size, distinct % size), axis=1), at
    live, last = np.flatnonzero(at >= 0), len(words) - 1
    for n in orders:
        live = live[live + n - 2 < last]
        live = live[at[live + n - 2] >= 0]
        phrases, names, counts = np.unique(key[live] * np.int64(size) + words[live + n - 1], return_inverse=True, return_counts=True)
        if not len(phrases):
            return
        heads = np.column_stack((heads[phrases // size], phrases % size))
        yield n, _joined(vocabulary, [*heads.T]), counts
        key = np.full(len(words), -1, np.int64)
        key[live] = names


def _streams(docs: DataFrame, orders: tuple[int, ...], bitmap: np.ndarray | None) -> DataFrame:
    """(lang, n, phrase, c) of every task's texts; a phrase comes once from each group of texts."""
    sent, most = docs.sparkSession.sparkContext.broadcast(bitmap), GROUP_BYTES

    def group(rows: dict[bytes, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang in sorted(rows):
            for n, phrases, counts in _counted(lang, rows[lang], orders, sent.value):
                for i in range(0, len(phrases), 50_000):
                    part = phrases.slice(i, 50_000)
                    size = len(part)
                    text = part.cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * size, pa.string()), pa.array(np.full(size, n, np.int32)), text, pa.array(counts[i : i + size].astype(np.int64))], ["lang", "n", "phrase", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = {}, 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if held and held + len(text) > most:
                    yield from group(rows)
                    rows, held = {}, 0
                rows.setdefault(lang.encode(), []).append(text)
                held += len(text)
        yield from group(rows)

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return in_small_batches(texts).mapInArrow(run, "lang string, n int, phrase string, c long")


def _added(streams: DataFrame, least: int) -> DataFrame:
    """The streams summed by phrase; what occurs less than ``least`` times goes, but for totals."""
    sums = streams.groupBy("lang", "n", "phrase").agg(F.sum("c").alias("f"))
    return sums.where((F.col("f") >= least) | (F.col("n") == 0))


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """The map of the phrases of a written table: at most ``MAP_BITS`` bits come to the driver, whatever the table's size."""
    bit = F.crc32(F.concat("lang", F.lit("\n"), "phrase")).bitwiseAND(MAP_BITS - 1)
    rows = frequent.select(F.shiftright(bit, 6).alias("at"), F.expr("1L").alias("one"), bit.bitwiseAND(63).cast("int").alias("by"))
    words = rows.groupBy("at").agg(F.bit_or(F.expr("shiftleft(one, by)")).alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, n, phrase, f): phrases of up to ``longest`` (at most 4) words with at least ``least`` occurrences, and with n = 0 the number of all words of a language."""
    one = cut(_added(_streams(docs, (0, 1), None), least), "phrases")
    two = cut(_added(_streams(docs, (2,), _bitmap(one.where("n = 1"))), least), "phrases")
    if longest == 2:
        return one.unionByName(two)
    more = cut(_added(_streams(docs, tuple(range(3, longest + 1)), _bitmap(two)), least), "phrases")
    return one.unionByName(two).unionByName(more)


def scored(counts: DataFrame, absorbs: int = ABSORBS) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all phrases of two words or more that no longer phrase absorbs; ``counts`` as of ``phrase_counts``, written.

    All joins merge streams sorted by language and phrase: a cut's first part, its rest, and the phrases one word longer.
    A phrase longer by more words holds one that is longer by a word and at least as frequent, so one word is enough.
    """
    known = counts.where("n >= 1").select("lang", "phrase", "f").hint("merge")
    phrases = counts.where("n >= 2").select("lang", "n", "phrase", F.col("f").alias("a"))
    longer = counts.where("n >= 3").select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', n - 1)"), F.expr("substring_index(phrase, ' ', 1 - n)"))).alias("phrase"), "f")
    extension = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most")).hint("merge")
    left = phrases.join(extension, ["lang", "phrase"], "left").where(f"most is null or 100 * cast(most as decimal(20, 0)) < {int(absorbs)} * cast(a as decimal(20, 0))")
    cuts = left.select("lang", "phrase", "n", "a", F.explode(F.expr("sequence(1, n - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - n)"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")).hint("merge"), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")).hint("merge"), ["lang", "rest"])
    score = F.expr("(2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)")
    lowest = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return lowest.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, absorbs: int = ABSORBS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, then occurrences, then byte order of the phrase."""
    counts = phrase_counts(docs, least, longest)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored(counts, absorbs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = counts.where("n = 0").select("lang", F.col("f").alias("n"))  # one row per language
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
