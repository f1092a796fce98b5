"""Mixing sources to target weights with hash-threshold histograms.

A source's target is its weight's share of all words, but at most ``MAX_EPOCHS`` times its own words; the
excess is shared anew by weight among the rest until no source is above its limit. A source is then taken
whole as often as its target allows, and once more for the documents whose hash lies below a threshold.
The threshold comes from histograms of words by source and hash bucket: the bucket where the
running sum passes the budget is refined alone, level by level, down to single hashes. Nothing is
sorted, only bounded histograms are. Thresholds are nested: a smaller budget takes a subset.

Hashes are the first 60 bits of the MD5 of ``doc_id`` as text, so that reruns and other engines agree.

Defined cases: a null text has size 0; a null source is a source, last in the order; rows with
one doc_id share a hash and are taken together; a source of no words has target 0; an empty table gives an
empty table; other columns are not read by ``mix`` and are kept by ``take``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import BROADCAST_ROWS, WORD, cut

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
HASH_BITS = 60
#: Bits that each level of the histogram resolves.
LEVEL_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows (source, size); one row per source.

    Sources in order of limit over weight fill up first; the first one that its share of what is left
    doesn't fill sets the level of all that follow. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    order = Window.orderBy(F.col("source_size") * 1.0 / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * max_epochs
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))) * 1.0 / F.sum("weight").over(rest)
    fits = F.when(F.col("level") * F.col("weight") <= cap, F.struct("place", "level"))
    return (
        per.withColumn("weight", weight)
        .withColumn("level", level.cast("double"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("level", F.min(fits).over(everything)["level"])
        .select("source", "source_size", F.least(F.col("level") * F.col("weight"), cap.cast("double")).alias("target"))
    )


def _by_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows with what their source has; null sources match. One row per source is broadcast if there are few."""
    per = per_source.withColumnRenamed("source", "_source")
    if per.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        per = F.broadcast(per)
    return rows.join(per, rows["source"].eqNullSafe(per["_source"])).drop("_source")


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): documents with a hash below it sum to the number of words nearest to ``budget`` that whole hashes allow.

    ``sizes`` has (source, hash, size), ``budgets`` has (source, budget), one row per source.
    """
    state = cut(budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("base")), "thresholds")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        # Only the boundary bucket of the level above: all of a source at first.
        inside = _by_source(sizes, state).where(F.shiftright("hash", shift + LEVEL_BITS) == F.shiftright("base", shift + LEVEL_BITS))
        histogram = inside.groupBy("source", "left", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        passed = histogram.withColumn("upto", upto).where("upto > left")
        first = F.min(F.struct("bucket", (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"), "words")).alias("at")
        boundary = passed.groupBy("source").agg(first)
        at = F.shiftleft(F.col("at.bucket"), shift)
        if shift == 0:  # a single hash: taken too if that comes nearer
            at = at + (F.col("at.words") < 2 * F.col("at.left")).cast("long")
        found = boundary.select(F.col("source").alias("_source"), F.col("at.left").alias("rest"), at.alias("at"))
        # A source whose budget is not passed takes all: its base goes past the last hash.
        new = state.join(found, state["source"].eqNullSafe(found["_source"]), "left")
        state = cut(new.select("source", F.coalesce("rest", "left").alias("left"), F.coalesce("at", F.lit(1 << HASH_BITS)).alias("base")), "thresholds")
    return state.select("source", F.col("base").alias("threshold"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """What each document needs (doc_id, source, size, hash), and per source (source_size, target, whole, threshold)."""
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("hash")), "sizes")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long")
    goal = cut(targets(sizes, weights, max_epochs).withColumn("whole", whole), "targets")
    limit = thresholds(sizes, goal.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    return sizes, cut(_by_source(goal, limit), "rules")


def copies(doc_hashes: Column, max_epochs: int = MAX_EPOCHS) -> Column:
    """How often a document is taken: its source's whole epochs, and once more below the threshold."""
    return F.col("whole") + ((doc_hashes < F.col("threshold")) & (F.col("whole") < max_epochs)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document."""
    sizes, rules = plan(docs, weights, max_epochs)
    return _by_source(sizes, rules).select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("hash"), max_epochs)).alias("taken"))


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, at most ``max_epochs`` times; rows taken 0 times go."""
    _, rules = plan(docs, weights, max_epochs)
    rules = rules.select("source", F.col("whole"), "threshold")
    row = docs.select("source", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    many = _by_source(row, rules).select("row", F.explode(F.array_repeat(F.lit(1), copies(doc_hash(F.col("row.doc_id")), max_epochs).cast("int"))))
    return many.select("row.*")
