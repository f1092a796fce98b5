"""MinHash near-dedup on SetSketch registers.

A register is the minimum of an exponential hash over a document's shingles, kept as a truncated
exponent of base ``BASE``: registers of two sets merge by maximum, and the share of equal registers
follows the sets' similarity. Documents whose registers agree in a whole band are candidates. For a
pair the counts of greater, smaller and equal registers and both set sizes give a joint likelihood of the
similarity; a pair for which the wanted similarity is out of the question goes, every other one is
verified on the full sets.

Copies cost nothing: documents of equal sets form a class before. Groups of near copies don't become all
pairs: first each document meets only the smallest and largest of each band's bucket, and of those it
is verified with the likeliest, then with the other likely ones of other components. Documents still outside
the main component of a bucket try a few more of its members, and what remains is compared with all of the
bucket's other components. So no link between components is lost, and links inside one are not listed.

Defined cases: a null or wordless text has no shingle and links with nothing; a text of fewer words than a shingle
is one shingle; a null doc_id links with nothing and has no component; rows that share a doc_id are one
node with all links of their texts and are returned each, ids being below 2**62; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from almanac.llm.common import BROADCAST_ROWS, checked_join, cut, in_small_batches
from almanac.llm.components import connected_components, merged_components

REGISTERS, BANDS = 120, 24
BASE, RATE, TOP = 1.02, 20.0, 2046
#: Registers whose parities differ in more than this many places are too unlike at any wanted similarity (0.8: 12 expected).
MOST_PARITY = 30
#: Times that a document outside its bucket's main component tries one more member of it before it meets all.
MATE_TURNS = 2
#: Members of a bucket up to which its components are compared pair by pair.
SMALL_BUCKET = 64
#: How far below the best log likelihood that of the wanted similarity may lie.
LIKELIHOOD_GAP = 14.0
#: Words that a worker remembers, and their bytes at most.
CACHE_WORDS, CACHE_BYTES = 150_000, 64
GROUP_CHARS = 1_000_000

_rng = np.random.default_rng(20260101)
_MULTIPLY = _rng.integers(1, 1 << 32, REGISTERS, np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, np.uint32)
_BAND_MULTIPLY = _rng.integers(1, 1 << 63, (BANDS, REGISTERS // BANDS), np.uint64) | np.uint64(1)
_PARITY = np.left_shift(np.uint64(1), np.arange(60, dtype=np.uint64))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_BYTES:
            self[word] = value
        return value


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    if len(_words) > CACHE_WORDS:
        _words.clear()
    tokens = [t.encode().lower().split() if t else [] for t in texts]
    sizes = [len(t) for t in tokens]
    flat = np.fromiter((h for t in tokens for h in map(_words.__getitem__, t)), np.uint64, sum(sizes))
    del tokens
    joined = flat
    for k in range(1, words):  # joined[i] covers flat[i : i + k + 1]
        joined = _mix(joined[: len(flat) - k] * np.uint64(0x9E3779B97F4A7C15) + flat[k:] + np.uint64(k)) if len(flat) > k else joined[:0]
    at = 0
    for n in sizes:
        if n >= words:
            yield np.unique(joined[at : at + n - words + 1])
        elif n:
            one = np.uint64(xxhash.xxh3_64_intdigest(flat[at : at + n].tobytes(), seed=n))
            yield np.array([one], np.uint64)
        else:
            yield np.empty(0, np.uint64)
        at += n


def registers(shingles: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set of hashes."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    half = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(half), 1024):
        v = half[at : at + 1024, None] * _MULTIPLY
        v += _ADD
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(13)
        np.minimum(low, v.min(axis=0), out=low)
    exponential = -np.log1p(-(low + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def band_hashes(regs: np.ndarray) -> np.ndarray:
    """One hash per band of each row of registers."""
    parts = regs.reshape(len(regs), BANDS, -1).astype(np.uint64) + np.uint64(1)
    return _mix((parts * _BAND_MULTIPLY).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, key1, key2 of the set, registers binary, bands array, p1 and p2: parities) of whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, texts in _groups(b["text"].tolist()):
                n, keys, regs = [], [], np.zeros((len(texts), REGISTERS), np.uint16)
                for i, s in enumerate(shingle_sets(texts, words)):
                    n.append(len(s))
                    keys.append(xxhash.xxh3_128_intdigest(s.tobytes()))
                    if len(s):
                        regs[i] = registers(s)
                odd = (regs & 1).astype(np.uint64)
                yield pd.DataFrame(
                    {
                        "doc_id": b["doc_id"].iloc[at : at + len(texts)].array,
                        "n_shingles": n,
                        "key1": np.array([k >> 64 for k in keys], np.uint64).view(np.int64),
                        "key2": np.array([k & (1 << 64) - 1 for k in keys], np.uint64).view(np.int64),
                        "registers": [r.tobytes() for r in regs],
                        "bands": list(band_hashes(regs)),
                        "p1": (odd[:, :60] * _PARITY).sum(axis=1, dtype=np.uint64).view(np.int64),
                        "p2": (odd[:, 60:] * _PARITY).sum(axis=1, dtype=np.uint64).view(np.int64),
                    }
                )

    return in_small_batches(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, n_shingles long, key1 long, key2 long, registers binary, bands array<long>, p1 long, p2 long")


def _groups(texts: list) -> Iterator[tuple[int, list]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars > GROUP_CHARS:
            yield start, texts[start : i + 1]
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def log_likelihood(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Log likelihood of each similarity of ``grid`` for pairs of sets with known sizes, a row per pair."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = np.minimum(grid[None, :], most)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    equal = REGISTERS - more - less
    tiny = 1e-12
    out = more[:, None] * np.log(np.maximum(up, tiny)) + less[:, None] * np.log(np.maximum(down, tiny)) + equal[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return np.where(grid[None, :] > most + 1e-9, -np.inf, out)


def estimated(pairs: DataFrame, sketches: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) that may have the similarity, with its likeliest value ``j``."""
    side = sketches.select("doc_id", "n_shingles", "registers")
    full = pairs.join(side.toDF("a", "n_a", "r_a"), "a").join(side.toDF("b", "n_b", "r_b"), "b")
    full = full.where(f"100 * least(n_a, n_b) >= {similarity} * greatest(n_a, n_b)")
    grid = np.linspace(0, 1, 101)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            ra, rb = (np.frombuffer(b"".join(b[c]), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
            ll = log_likelihood(b["n_a"].to_numpy(float), b["n_b"].to_numpy(float), (ra > rb).sum(axis=1), (ra < rb).sum(axis=1), grid)
            wanted = ll[:, grid >= similarity / 100 - 1e-9].max(axis=1)
            j = grid[ll.argmax(axis=1)]
            keep = wanted >= ll.max(axis=1) - LIKELIHOOD_GAP
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "j": j})[keep]

    return in_small_batches(full.select("a", "b", "n_a", "n_b", "r_a", "r_b")).mapInPandas(run, "a long, b long, j double")


def shingle_table(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, s: the full shingle set) of the documents with these ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, texts in _groups(b["text"].tolist()):
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[at : at + len(texts)].array, "s": [s.view(np.int64) for s in shingle_sets(texts, words)]})

    return cut(in_small_batches(checked_join(docs.select("doc_id", "text"), ids, "doc_id", "left_semi")).mapInPandas(run, "doc_id long, s array<long>"), "sets")


def verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have the similarity."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "verify-ids")
    sets = shingle_table(docs, ids, words)
    full = pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")
    both = full.withColumn("shared", F.size(F.array_intersect("s_a", "s_b")))
    return both.where(100 * F.col("shared") >= similarity * (F.size("s_a") + F.size("s_b") - F.col("shared"))).select("a", "b")


def differing(members: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """Pairs (a, b) that may link the components of each group, by how their sets differ from the group's pivot.

    ``members`` has (main, id, component); the pivot is what most of a main component's sets hold. With ``a``
    pivot shingles missing and ``b`` others present, two sets have the similarity exactly if the differences that they
    share, times 100 + similarity, reach both weights ``100 a + similarity b`` less the pivot's slack. Differences
    that one document alone has join with nothing, and a shared one counts only if enough follow it in the order
    from rare to frequent, so near copies that differ each in their own way don't meet. Pairs that need share
    nothing all link with the group's document of least weight, so that pair stands for them.
    """
    sets = shingle_table(docs, cut(members.select(F.col("id").alias("doc_id")).distinct(), "member-ids"), words).dropDuplicates(["doc_id"])
    held = members.join(sets.withColumnRenamed("doc_id", "id"), "id")
    core = held.where("component = main")
    half = cut(core.groupBy("main").agg((F.count("*") / 2).alias("half")), "half")
    common = core.select("main", F.explode("s").alias("e")).groupBy("main", "e").count()
    pivot = checked_join(common, half, "main", "inner").where("count > half")
    pivot = cut(pivot.groupBy("main").agg(F.collect_list("e").alias("pivot")), "pivot")
    few = (pivot.agg(F.sum(F.size("pivot"))).first()[0] or 0) <= BROADCAST_ROWS
    both = held.join(F.broadcast(pivot) if few else pivot, "main", "left").withColumn("pivot", F.coalesce("pivot", F.array().cast("array<long>")))
    both = both.withColumn("gone", F.array_except("pivot", "s")).withColumn("more", F.array_except("s", "pivot"))
    weight = 100 * F.size("gone") + similarity * F.size("more")
    slack = (100 - similarity) * F.size("pivot")
    both = cut(both.select("main", "id", "component", weight.alias("w"), slack.alias("slack"), F.concat("gone", "more").alias("d")), "differences")
    nearest = cut(both.groupBy("main").agg(F.min_by(F.struct("id", "component", "w"), F.struct("w", "id")).alias("least")), "nearest")
    both = checked_join(both, nearest, "main", "inner").withColumn("short", F.col("w") + F.col("least.w") - F.col("slack"))
    sure = both.where("short <= 0 and component <> least.component").select(F.least("id", "least.id").alias("a"), F.greatest("id", "least.id").alias("b"))
    each = both.select("main", "id", "component", "w", "slack", "short", F.explode("d").alias("e"))
    order = each.groupBy("main", "e").agg(F.count("*").alias("n")).where("n > 1")
    each = each.join(order, ["main", "e"])
    document = Window.partitionBy("main", "id")
    each = each.withColumn("rest", F.row_number().over(document.orderBy(F.desc("n"), F.desc("e"))))  # shared differences from here on
    each = cut(each.where(f"{100 + similarity} * rest >= short").select("main", "id", "component", "w", "slack", "e", "rest"), "shared-differences")
    x, y = each.alias("x"), each.alias("y")
    enough = (100 + similarity) * F.least("x.rest", "y.rest") >= F.col("x.w") + F.col("y.w") - F.col("x.slack")
    meet = (F.col("x.main") == F.col("y.main")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
    return sure.union(x.join(y, meet & enough).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))).distinct()


def nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame | None, bool]:
    """The documents with a column ``dedup_node`` that each text of a doc_id has to itself.

    It is the doc_id, but for further texts of one doc_id a number beyond the usual ids. Also (dedup_node, owner) of
    those further texts, None without any, and whether a node has several rows.
    """
    text_hash = F.xxhash64("text")
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(text_hash).alias("dedup_text"), F.max(text_hash).alias("most"))
    again = cut(ids.where("n > 1").withColumn("several", F.col("dedup_text") < F.col("most")).drop("n", "most"), "repeated")
    flags = again.agg(F.count("*"), F.count(F.when(F.col("several"), 1))).first()
    key = F.col("doc_id").cast("long")
    if not flags[1]:
        return docs.withColumn("dedup_node", key), None, flags[0] > 0
    keyed = checked_join(docs, again.where("several").select("doc_id", "dedup_text"), "doc_id", "left")
    other = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).bitwiseOR(F.lit(1 << 62))
    keyed = keyed.withColumn("dedup_node", F.when(text_hash != F.col("dedup_text"), other).otherwise(key)).drop("dedup_text")
    further = keyed.where("dedup_node <> doc_id").select("dedup_node", key.alias("owner")).distinct()
    return keyed, cut(further, "further"), True


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``; ``similarity`` in hundredths."""
    keyed, further, several = nodes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out, found = _groups_of_nodes(keyed.select(F.col("dedup_node").alias("doc_id"), "text"), words, similarity, several)
    if further is None:
        out = checked_join(out, found, "id", "left")
    else:
        # Texts of one doc_id belong together, and components go by doc_id.
        ends = further.select(F.col("owner").alias("a"), F.col("dedup_node").alias("b"))
        copies = out.where("id <> doc_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
        found = cut(merged_components(found, cut(ends.union(copies).distinct(), "owners")), "components")
        out = checked_join(out.drop("id").withColumn("id", F.col("doc_id")), found, "id", "left")
        out = checked_join(out.withColumnRenamed("doc_id", "dedup_node"), further, "dedup_node", "left").select(F.coalesce("owner", "dedup_node").alias("doc_id"), "id", "n_shingles", "component")
    component = F.coalesce("component", "id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _groups_of_nodes(docs: DataFrame, words: int, similarity: int, several: bool) -> tuple[DataFrame, DataFrame]:
    """Each row's (doc_id, id of its class, n_shingles), and (id, component) of the classes that have links.

    Rows of one doc_id must have one text; ``several``: whether there may be such rows.
    """
    sk = cut(sketch(docs, words), "sketch")
    linkable = sk.where("n_shingles > 0 and doc_id is not null")
    if several:
        linkable = cut(linkable.dropDuplicates(["doc_id"]), "nodes")
        docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    # Documents of equal sets: the smallest stands for all.
    classes = linkable.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")).where("rep < most").drop("most")
    copies = checked_join(linkable.select("doc_id", "key1", "key2"), cut(classes, "classes"), ["key1", "key2"], "inner")
    copies = cut(copies.where("doc_id <> rep").select("doc_id", "rep"), "copies")
    reps = checked_join(linkable, copies.select("doc_id"), "doc_id", "left_anti")
    reps = cut(reps.drop("key1", "key2"), "reps") if copies.limit(1).count() else reps
    # Buckets that more than one class shares.
    bands = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band"))
    centres = cut(bands.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi"), "centres")
    shared = cut(checked_join(bands, centres, "band", "inner"), "shared")
    star = shared.where("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).union(shared.where("id <> hi and id <> lo").select(F.col("id").alias("a"), F.col("hi").alias("b"))).distinct()
    tested = cut(estimated(star, reps, similarity), "likely")
    best = tested.groupBy("b").agg(F.max_by("a", "j").alias("a")).select("a", "b")
    links = verified(cut(best, "best"), docs, words, similarity)
    found = cut(connected_components(links), "components")

    def grown(pairs: DataFrame) -> None:
        """Verify pairs between components, and merge the components that links are found between."""
        nonlocal found
        new = cut(verified(cut(pairs.select("a", "b").distinct(), "pairs"), docs, words, similarity), "links")
        if new.limit(1).count():
            found = cut(merged_components(found, new), "components")

    # The other likely star pairs, where they lie in different components.
    ends = [found.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab"]
    both = checked_join(checked_join(tested, ends[0], "a", "left"), ends[1], "b", "left")
    grown(both.where("coalesce(c_a, a) <> coalesce(c_b, b)"))
    # Members outside a bucket's main component: against other members of it, few at a time, then against all.
    side = F.struct("id", "n", "p1", "p2")
    narrow = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "p1", "p2", "bands")
    narrow = cut(narrow.join(shared.select("id").distinct(), "id", "left_semi"), "narrow")
    for turn in range(MATE_TURNS + 1):
        there = checked_join(shared.select("id", "band"), found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        main = there.groupBy("band", "component").count().groupBy("band").agg(F.max_by("component", "count").alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
        there = cut(checked_join(there, cut(main, "main"), "band", "inner").join(narrow, "id"), "buckets")
        if turn == MATE_TURNS:
            large = cut(there.groupBy("band").count().where(f"count > {SMALL_BUCKET}").select("band"), "large")
            crowd = cut(checked_join(there, large, "band", "left_semi").select("main", "id", "component").distinct(), "crowd")
            there = checked_join(there, large, "band", "left_anti")
        x = there.where("component <> main").alias("x")
        if turn < MATE_TURNS:
            mate = F.min_by(side, F.xxhash64("id", "band", F.lit(turn))).alias("y")
            y = cut(there.where("component = main").groupBy("band").agg(mate).select("band", "y.*", F.lit(None).cast("long").alias("component")), "mates")
            y = (F.broadcast(y) if y.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else y).alias("y")  # written, so that Spark may split hot bands
            once = F.lit(True)
        else:
            y = there.alias("y")
            first = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.band")  # a pair meets once
            once = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))) & first
        near = 100 * F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n")
        near &= F.bit_count(F.col("x.p1").bitwiseXOR(F.col("y.p1"))) + F.bit_count(F.col("x.p2").bitwiseXOR(F.col("y.p2"))) <= MOST_PARITY
        pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & near & once).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        pairs = pairs.distinct() if turn < MATE_TURNS else pairs.union(differing(crowd, docs, words, similarity)).distinct()
        grown(estimated(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), reps, similarity))
    return checked_join(sk.select("doc_id", "n_shingles"), copies, "doc_id", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("id"), "n_shingles"), found


def keep_one(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """The documents with one of each group of near copies kept, all columns.

    Rows that repeat doc_id and text count as copies; another text under the same doc_id is a document of its own,
    and rows without doc_id all stay.
    """
    keyed, _, several = nodes(docs)
    rows, found = _groups_of_nodes(keyed.select(F.col("dedup_node").alias("doc_id"), "text"), words, similarity, several)
    groups = checked_join(rows, found, "id", "left")
    gone = groups.where("doc_id is not null and doc_id <> coalesce(component, id)").select(F.col("doc_id").alias("dedup_node")).distinct()
    out = checked_join(keyed, cut(gone, "gone"), "dedup_node", "left_anti")
    if several:
        out = out.where("dedup_node is not null").dropDuplicates(["dedup_node"]).union(out.where("dedup_node is null"))
    return out.select(*docs.columns)
