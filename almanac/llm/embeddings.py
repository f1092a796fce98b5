"""Embedding near-dedup with a random-projection tree forest.

Every tree splits the vectors of a label again and again at the mean of a random projection, until a
node has at most ``LEAF`` vectors or its projections hardly differ. Vectors close to a split go to
both sides, so leaves overlap. Vectors are compared within leaves, in blocks where a leaf is
large, and a pair that meets in many leaves counts in the smallest shared leaf alone. A group too tight to split
is nearly the same leaf in every tree, so large leaves are laid out in blocks by the first large leaf of their members,
and members who met there are not compared again. A block sends back link counts and a spanning forest, not its pairs.

Exact copies form a class before and are compared once.

Defined cases: vectors that are null, empty or zero, that hold a null or non-finite component, or have no label
or vec_id, link with nothing; vectors of different lengths do not link; rows that share vec_id,
label and vector are one vector and are returned each; other rows that share a vec_id are vectors of their own; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import checked_join, cut
from almanac.llm.components import connected_components

TREES, LEVELS, LEAF = 8, 24, 256
#: A vector this close to a split (in units of the unit sphere) goes to both sides, but never more than about a fifth of a node.
SPILL, SPILL_SHARE = 0.0125, 0.25
#: In ``dim`` dimensions, vectors whose pairs have a mean cosine of s deviate by about sqrt((1 - s) / dim) along a direction.
#: A node that deviates by at most so many times this, for the wanted s, is compared whole, in blocks: splits would part its links.
#: With 1, groups of a mean cosine just below the wanted one lost a tenth of their links in a model; with 2, none of those tried did.
TIGHT = 2.0
BLOCK = 1024
#: Leaves that are looked up together.
TILE = 256
SEED = 7


def directions(dim: int) -> np.ndarray:
    """Unit vectors, one per tree and level."""
    d = np.random.default_rng([SEED, dim]).standard_normal((TREES * LEVELS, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def _units(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), dtype=float)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def project(vectors: DataFrame) -> DataFrame:
    """A row per vector and tree: (id, label, dim, tree, node, p: projections by level)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, rows in b.groupby(b["embedding"].map(len)):
                p = (_units(rows["embedding"]) @ directions(dim).T).astype(np.float32).reshape(len(rows) * TREES, LEVELS)
                out = rows[["id", "label"]].loc[rows.index.repeat(TREES)]
                yield pd.DataFrame({"id": out["id"].to_numpy(), "label": out["label"].to_numpy(), "dim": dim, "tree": np.tile(np.arange(TREES), len(rows)), "node": 1, "p": list(p)})

    return vectors.select("id", "label", "embedding").mapInPandas(run, "id long, label long, dim int, tree int, node long, p array<float>")


def leaves(vectors: DataFrame, similarity: float) -> DataFrame:
    """(id, leaf, members) for every leaf that a vector is in, over all trees."""
    key = ["label", "dim", "tree", "node"]
    state, found = cut(project(vectors), "trees"), []
    for level in range(LEVELS + 1):
        at = state.withColumn("x", F.col("p")[level].cast("double") if level < LEVELS else F.lit(0.0))
        stats = at.groupBy(*key).agg(F.count("*").alias("members"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread"))
        stats = cut(stats, "nodes")
        split = (F.col("members") > LEAF) & (F.col("spread") > TIGHT * F.sqrt(F.lit(max(1.0 - similarity, 0.0)) / F.col("dim")))
        spill = F.least(F.lit(SPILL), SPILL_SHARE * F.col("spread"))
        left, right = F.col("x") <= F.col("mean") + spill, F.col("x") >= F.col("mean") - spill
        child = F.when(split, F.array_compact(F.array(F.when(left, F.col("node") * 2), F.when(right, F.col("node") * 2 + 1)))).otherwise(F.array(-F.col("node")))
        state = cut(checked_join(at, stats, key, "inner").select("id", "label", "dim", "tree", F.explode(child).alias("node"), "p", "members"), "trees")
        found.append(state.where("node < 0").select("id", F.xxhash64(*key).alias("leaf"), "members"))
        state = state.where("node > 0").drop("members")
        if not state.limit(1).count():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def seats(lists: DataFrame) -> DataFrame:
    """(id, all, leaf, own, with): in every leaf of an id, its block and the blocks that this is compared with.

    ``first`` is the smallest large leaf of an id. Members of a leaf with the same ``first`` before it met there, so where they
    are many they get blocks of their own, which are not compared with each other; the others share blocks that are.
    """
    large = F.filter("in", lambda x: x["members"] > LEAF)
    at = lists.select("id", F.col("in.leaf").alias("all"), F.array_min(F.transform(large, lambda x: x["leaf"])).alias("first"), F.explode("in").alias("at"))
    at = at.select("id", "all", "first", "at.leaf", (F.col("at.members") > LEAF).alias("large"))
    met = at.where("large").groupBy("leaf", "first").agg(F.count("*").alias("n"))
    met = cut(met.withColumn("seat", F.when((F.col("first") < F.col("leaf")) & (F.col("n") > LEAF), F.col("first"))), "met")
    plan = met.groupBy("leaf", "seat").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    by_leaf = Window.partitionBy("leaf")
    plan = plan.withColumn("start", (F.sum("blocks").over(by_leaf.orderBy("seat")) - F.col("blocks")).cast("int")).withColumn("total", F.sum("blocks").over(by_leaf).cast("int"))
    plan = plan.withColumn("seat", F.coalesce("seat", "leaf"))  # a seat of its own is never the leaf itself
    met = cut(met.withColumn("seat", F.coalesce("seat", "leaf")).select("leaf", "first", "seat").join(plan, ["leaf", "seat"]), "seats")
    at = checked_join(at, met, ["leaf", "first"], "left")
    own = F.col("start") + F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("total") - 1)
    others = F.when(F.col("seat") == F.col("leaf"), others).otherwise(F.filter(others, lambda x: (x < F.col("start")) | (x >= F.col("start") + F.col("blocks"))))
    one = ~F.col("large")
    return at.select("id", "all", "leaf", F.when(one, F.lit(0)).otherwise(own).alias("own"), F.when(one, F.array(F.lit(0))).otherwise(others).alias("with"))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _first_meeting(lists: pd.Series, leaf: int, rows: np.ndarray, cols: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs (i, j) out of ``rows`` and ``cols`` share no leaf before ``leaf``: a 0/1 product of members and leaves, by tiles of leaves."""
    sizes = lists.map(len).to_numpy()
    member, other = np.repeat(np.arange(len(lists)), sizes), np.concatenate(lists.to_numpy())
    before = other < leaf
    member, other = member[before], other[before]
    _, place, n = np.unique(other, return_inverse=True, return_counts=True)
    member, place = member[n[place] > 1], place[n[place] > 1]  # leaves of one member alone are shared by no pair
    _, place = np.unique(place, return_inverse=True)
    shared = np.zeros((len(rows), len(cols)), np.float32)
    for at in range(0, int(place.max(initial=-1)) + 1, TILE):
        tile = np.zeros((len(lists), TILE), np.float32)
        here = (place >= at) & (place < at + TILE)
        tile[member[here], place[here] - at] = 1
        shared += tile[rows] @ tile[cols].T
    return shared[np.searchsorted(rows, i), np.searchsorted(cols, j)] == 0


def compare(similarity: float):
    """Links of one block pair of a leaf: (id, other, links); a null other carries link counts, else an edge."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id")
        leaf, first = b["leaf"].iloc[0], (b["own"] == b["block_i"]).to_numpy()
        second = (b["own"] == b["block_j"]).to_numpy()
        ids, size = b["id"].to_numpy(), b["copies"].to_numpy()
        rows, cols = np.flatnonzero(first), np.flatnonzero(second)
        unit = _units(b["embedding"])
        i, j = np.nonzero(unit[rows] @ unit[cols].T >= similarity)
        i, j = rows[i], cols[j]
        if b["block_i"].iloc[0] == b["block_j"].iloc[0]:
            i, j = i[i < j], j[i < j]
        keep = _first_meeting(b["all"], leaf, rows, cols, i, j)
        i, j = i[keep], j[keep]
        if not len(i):
            return pd.DataFrame({"id": [], "other": [], "links": []})
        links = np.bincount(i, size[j], len(b)) + np.bincount(j, size[i], len(b))
        root = _roots(len(b), i, j)
        hit, edge = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(b)))
        return pd.DataFrame(
            {
                "id": np.concatenate((ids[hit], ids[edge])),
                "other": pd.array([None] * len(hit) + ids[root[edge]].tolist(), "Int64"),
                "links": np.concatenate((links[hit].astype(np.int64), np.zeros(len(edge), np.int64))),
            }
        )

    return run


def near_duplicates(vectors: DataFrame, similarity: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding, label)."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = F.coalesce(good & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    base = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", good.alias("good")), "vectors")
    # A class is found again by its label and a digest of 128 bits; those of one vector under its own id need not be.
    digest = F.struct(F.xxhash64("label", "embedding"), F.xxhash64("embedding", "label", F.lit(1)))
    classes = base.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count_distinct("vec_id").alias("copies"))
    classes = cut(classes.withColumn("class", digest).withColumn("id", F.col("low")), "classes")
    repeated = cut(classes.groupBy("low").count().where("count > 1").select("low", F.lit(True).alias("again")), "repeated")
    several_under_one_id = bool(repeated.limit(1).count())
    if several_under_one_id:  # each gets an id beyond the usual ones
        own = F.shiftrightunsigned(F.xxhash64("low", "class"), 2).bitwiseOR(F.lit(1 << 62))
        classes = cut(checked_join(classes, repeated, "low", "left").withColumn("id", F.when(F.col("again"), own).otherwise(F.col("low"))), "classes")
    lists = leaves(classes, similarity).groupBy("id").agg(F.collect_list(F.struct("leaf", "members")).alias("in"))  # at most a few per tree
    places = seats(cut(lists, "leaves"))
    rows = classes.join(places, "id").select("id", "label", F.size("embedding").alias("dim"), "copies", "embedding", "all", "leaf", "own", F.explode("with").alias("with"))
    rows = rows.withColumn("block_i", F.least("own", "with")).withColumn("block_j", F.greatest("own", "with")).drop("with")
    found = cut(rows.groupBy("label", "dim", "leaf", "block_i", "block_j").applyInPandas(compare(similarity), "id long, other long, links long"), "links")
    links = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    if several_under_one_id:
        real = checked_join(components, cut(classes.where("id <> low").select("id", "low"), "real"), "id", "left")
        components = real.withColumn("component", F.min(F.coalesce("low", "id")).over(Window.partitionBy("component"))).drop("low")
    per_class = cut(links.join(components, "id", "full"), "found")  # only of vectors with links
    several = cut(classes.where("copies > 1 or id <> low").select("class", "id", "low", "copies"), "several")
    out = checked_join(base.select("vec_id", F.when(F.col("good"), digest).alias("class")), several, "class", "left")
    out = out.select("vec_id", F.coalesce("id", "vec_id").alias("id"), F.coalesce("low", "vec_id").alias("low"), F.coalesce("copies", F.lit(1)).alias("copies"))
    out = checked_join(out, per_class, "id", "left")
    component = F.coalesce("component", "low")
    return out.select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
