"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import BROADCAST_ROWS, checked_join, cut


def _left(edges: DataFrame) -> tuple[int, int]:
    """Number of edges, and of ids that keep them from being stars: with two centres, or centre and leaf at once."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(0).alias("leaf")), F.struct(F.col("b").alias("id"), F.lit(1).alias("leaf")))).alias("e")).select("e.*")
    per = ends.groupBy("id").agg(F.sum("leaf").alias("centres"), F.min("leaf").alias("only"))
    found = per.agg(F.sum("centres"), F.expr("count_if(centres > 1 or centres = 1 and only = 0)")).first()
    return found[0] or 0, found[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the edges (a, b); the component is its smallest id.

    Each step moves edges to smaller centres and keeps at most one edge per pair, so the edge set never
    grows beyond its start; steps are about the logarithm of the longest chain, and end once the edges are
    stars. Only minima are aggregated, no neighbour list is gathered; minima are broadcast only if the counted
    edges are few enough. Null ids and loops are ignored.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    now = cut(edges.where("a is not null and b is not null and a <> b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    n, open_ids = _left(now)
    while open_ids:
        few = F.broadcast if 2 * n <= BROADCAST_ROWS else lambda df: df
        # Large star: the larger neighbours of each id move to the least of its neighbourhood.
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(few(least), "a").where("b > a").select(F.col("m").alias("a"), "b")
        # Small star: an id and its smaller neighbours move to the least of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(few(least), "b")
        now = cut(small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct(), "edges")
        n, open_ids = _left(now)
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def merged_components(found: DataFrame, new: DataFrame) -> DataFrame:
    """Components (id, component) after links ``new`` (a, b) join those ``found``; both already written.

    The new links are contracted to links between components first, so the work grows with them alone.
    """
    ends = [found.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab"]
    both = new.join(ends[0], "a", "left").join(ends[1], "b", "left")
    moved = cut(connected_components(both.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))), "merged")
    to = moved.toDF("component", "to")
    old = checked_join(found, to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return old.union(moved).distinct()
