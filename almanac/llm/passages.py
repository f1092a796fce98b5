"""Removal of byte strings that an earlier document has too, by sorting the suffixes of shards.

A string of ``SPAN`` bytes is removed from a document if it also starts in one with a smaller doc_id. Equal strings must meet
in one shard, so each string is sent by the least hash of the ``GRAM``-byte stretches inside it: neighbouring strings with the
same least stretch travel as one segment. A first pass sends the hashes alone and keeps those of two documents or
more; only their segments go to shards. There the suffixes of the distinct segments are sorted by external induction
(see ``induced``): strings are equal where the common prefix is ``SPAN`` at least, and the least doc_id of equal strings goes back
to where they came from.

Documents are dealt into chunks of some megabytes by doc_id. A chunk sends a hash or a segment once, however many of its
documents hold it, with their least and greatest doc_id, so a passage that a third of all documents share is a row per
chunk. The three passes over the texts read one and the same exchange. Copies of whole documents are known by their digest
and take no part: the one with the least doc_id stands for all.

Defined cases: null texts are empty; documents below ``SPAN`` bytes keep all; a null doc_id is neither removed from nor removes;
rows of one doc_id don't remove from each other; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import cut, in_small_batches
from almanac.llm.induced import sorted_blocks

SPAN, GRAM = 50, 20
#: Bytes of text in a chunk, on average. A shard and a bucket of hashes are smaller.
CHUNK_BYTES = 4 << 20
#: Strings of a segment at most; a longer stretch with one least hash, as in a line of dashes, is sent in parts.
SEGMENT = 256
#: Tuples that a queue of a shard's sort holds in memory.
QUEUE_TUPLES = 1 << 24

BLOCK = 1 << 17  # positions hashed together, so that they stay in a processor's cache
HASH_BITS = 48
KIND_COPY, KIND_SHARED, KIND_FOUND = 0, 1, 2
SIDE = "chunk int, kind int, payload binary"
FOUND = np.dtype([("id", "<i4"), ("at", "<i4"), ("n", "<i4"), ("least", "<i8")])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64))


def least_hashes(data: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """For each string of ``span`` bytes the least hash, of 48 bits, of the stretches of ``gram`` bytes in it."""
    n = len(data) - span + 1
    out = np.empty(max(n, 0), np.int64)
    for a in range(0, n, BLOCK):
        part = data[a : a + BLOCK + span - 1].astype(np.uint64) + np.uint64(1)
        now, width, whole, length, rest = part, 1, None, 0, gram
        while True:  # hashes of stretches of 1, 2, 4, ... bytes, joined by the bits of ``gram``
            if rest & 1:
                if whole is None:
                    whole = now
                else:
                    m = len(now) - length
                    whole = whole[:m] * _power(width) + now[length : length + m]
                length += width
            rest >>= 1
            if not rest:
                break
            now = now[:-width] * _power(width) + now[width:]
            width *= 2
        whole = whole ^ (whole >> np.uint64(29))
        whole *= np.uint64(0xBF58476D1CE4E5B9)
        whole >>= np.uint64(64 - HASH_BITS)
        low, width, wanted = whole.astype(np.int64), 1, span - gram + 1
        while 2 * width <= wanted:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if wanted > width:
            low = np.minimum(low[: width - wanted], low[wanted - width :])
        out[a : a + len(low)] = low
    return out


class Chunk:
    """The documents of a chunk that take part, under one another in order of doc_id, and their segments."""

    def __init__(self, docs: pa.Table, side: pa.Table):
        ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, texts[k]))
        self.ids, self.texts = [ids[k] for k in order], [texts[k] for k in order]
        kinds = side.column("kind").to_numpy()
        payloads = side.column("payload").to_pylist()
        copies: dict[int, set[bytes]] = {}
        for k in np.flatnonzero(kinds == KIND_COPY).tolist():
            copies.setdefault(int.from_bytes(payloads[k][:8], "big", signed=True), set()).add(payloads[k][8:])
        self.copy = [i is not None and i in copies and hashlib.sha256(t).digest() in copies[i] for i, t in zip(self.ids, self.texts, strict=True)]
        self.rows = [k for k, i in enumerate(self.ids) if i is not None and not self.copy[k] and len(self.texts[k]) >= SPAN]
        self.data = np.frombuffer(b"".join([self.texts[k] for k in self.rows]), np.uint8)
        self.sizes = np.array([len(self.texts[k]) for k in self.rows], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.doc_ids = np.array([self.ids[k] for k in self.rows], np.int64)
        self.shared = np.sort(_hashes(b"".join(payloads[k] for k in np.flatnonzero(kinds == KIND_SHARED).tolist())))
        self.found = np.frombuffer(b"".join(payloads[k] for k in np.flatnonzero(kinds == KIND_FOUND).tolist()), FOUND)
        windows = self.sizes - SPAN + 1
        owner = np.repeat(np.arange(len(self.rows)), windows)
        place = np.arange(len(owner)) + np.repeat(self.begins - (np.cumsum(windows) - windows), windows)
        hashes = least_hashes(self.data)[place] if len(place) else np.zeros(0, np.int64)
        new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))) if len(owner) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(owner)))
        parts = -(-size // SEGMENT)
        which = np.repeat(np.arange(len(new)), parts)
        step = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        #: Of each segment: place of its first string, number of strings, hash, and document.
        self.first, self.count = place[new[which] + step], np.minimum(size[which] - step, SEGMENT)
        self.hash, self.owner = hashes[new[which]], owner[new[which]]

    def keep_shared(self) -> None:
        """Only segments of shared hashes; equal ones get one number, in order of first appearance."""
        at = np.minimum(np.searchsorted(self.shared, self.hash), max(len(self.shared) - 1, 0))
        keep = np.flatnonzero(self.shared[at] == self.hash) if len(self.shared) else np.zeros(0, np.int64)
        self.first, self.count, self.hash, self.owner = self.first[keep], self.count[keep], self.hash[keep], self.owner[keep]
        raw = self.data.tobytes()
        flat = np.empty(len(keep), object)
        flat[:] = [raw[a:b] for a, b in zip(self.first.tolist(), (self.first + self.count + SPAN - 1).tolist(), strict=True)]
        self.number, self.segments = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), flat)


def _hashes(blob: bytes) -> np.ndarray:
    six = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return np.concatenate((six, np.zeros((len(six), 2), np.uint8)), axis=1).view("<i8").ravel()


def _blob(hashes: np.ndarray) -> bytes:
    return hashes.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _groups(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of a sorted array."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip(keys[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True))


HASHED = "bucket int, chunk int, once binary, often binary"
SEGMENTS = "shard int, chunk int, ids binary, sizes binary, least binary, most binary, data binary"
OUT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _hash_rows(n: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        chunk, c = int(docs.column("chunk")[0].as_py()) if docs.num_rows else -1, Chunk(docs, side)
        order = np.lexsort((c.doc_ids[c.owner], c.hash))
        hashes, ids = c.hash[order], c.doc_ids[c.owner][order]
        new = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(hashes)) - 1
        often, hashes = ids[new] < ids[last], hashes[new]
        bucket = hashes % n
        order = np.argsort(bucket, kind="stable")
        bucket, hashes, often = bucket[order], hashes[order], often[order]
        rows = [(b, chunk, _blob(hashes[i:j][~often[i:j]]), _blob(hashes[i:j][often[i:j]])) for b, i, j in _groups(bucket)]
        return _table(rows, [("bucket", pa.int32()), ("chunk", pa.int32()), ("once", pa.binary()), ("often", pa.binary())])

    return run


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(x, kind) for x, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


_SIDE = [("chunk", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())]


def _shared_rows(rows: pa.Table) -> pa.Table:
    """Hashes that two documents have, for each chunk that has them."""
    chunks = rows.column("chunk").to_numpy()
    found = []
    for name in ("once", "often"):
        blobs = [_hashes(x) for x in rows.column(name).to_pylist()]
        found.append((np.concatenate(blobs), np.repeat(chunks, [len(x) for x in blobs])))
    hashes, chunk = (np.concatenate(x) for x in zip(*found, strict=True))
    weight = np.repeat([1, 2], [len(x) for x, _ in found])
    order = np.argsort(hashes, kind="stable")
    hashes, chunk, weight = hashes[order], chunk[order], weight[order]
    new = np.append(True, hashes[1:] != hashes[:-1]) if len(hashes) else np.zeros(0, bool)
    name = np.cumsum(new) - 1
    shared = np.bincount(name, weight)[name] > 1 if len(hashes) else new
    hashes, chunk = hashes[shared], chunk[shared]
    order = np.argsort(chunk, kind="stable")
    hashes, chunk = hashes[order], chunk[order]
    return _table([(c, KIND_SHARED, _blob(hashes[i:j])) for c, i, j in _groups(chunk)], _SIDE)


def _segment_rows(n: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        chunk, c = int(docs.column("chunk")[0].as_py()) if docs.num_rows else -1, Chunk(docs, side)
        c.keep_shared()
        least, most, shard = (np.zeros(len(c.segments), np.int64) for _ in range(3))
        ids = c.doc_ids[c.owner]  # ascending
        most[c.number], shard[c.number] = ids, c.hash % n
        least[c.number[::-1]] = ids[::-1]
        order = np.argsort(shard, kind="stable")
        rows = []
        for s, i, j in _groups(shard[order]):
            at = order[i:j]
            texts = c.segments[at].tolist()
            rows.append((s, chunk, at.astype("<i4").tobytes(), np.array([len(t) for t in texts], "<i4").tobytes(), least[at].tobytes(), most[at].tobytes(), b"".join(texts)))
        return _table(rows, [("shard", pa.int32()), ("chunk", pa.int32()), *[(x, pa.binary()) for x in ("ids", "sizes", "least", "most", "data")]])

    return run


def earliest(segments: list[bytes], least: np.ndarray, span: int = SPAN, limit: int = QUEUE_TUPLES) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct segments with a number each: for all strings of ``span`` bytes, in order, (segment, least number of the segments that hold an equal string)."""
    sizes = np.array([len(s) for s in segments], np.int64)
    text = np.frombuffer(b"\xff".join([*segments, b""]), np.uint8) + np.uint8(1)  # ends become 0
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    value = least[owner]
    for places, common in sorted_blocks(text, limit):
        if len(places):
            first = np.flatnonzero(np.append(True, common[1:] < span))
            low = np.minimum.reduceat(least[owner[places]], first)
            value[places] = np.repeat(low, np.diff(np.append(first, len(places))))
    ends = np.cumsum(sizes + 1) - 1
    whole = np.flatnonzero(ends[owner] - np.arange(len(text)) >= span)
    return owner[whole], value[whole]


def _sorted_rows(limit: int):
    def run(rows: pa.Table) -> pa.Table:
        """For each chunk and segment the stretches of strings that an earlier document has."""
        texts, chunk, ids, least, most = [], [], [], [], []
        for r in rows.to_pylist():
            sizes = np.frombuffer(r["sizes"], "<i4")
            ends = np.cumsum(sizes)
            texts += [r["data"][a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            chunk.append(np.full(len(sizes), r["chunk"], np.int64))
            for out, name, kind in ((ids, "ids", "<i4"), (least, "least", np.int64), (most, "most", np.int64)):
                out.append(np.frombuffer(r[name], kind))
        chunk, ids, least, most = (np.concatenate(x) for x in (chunk, ids, least, most))
        flat = np.empty(len(texts), object)
        flat[:] = texts
        number, segments = pd.factorize(flat)
        low = np.full(len(segments), np.iinfo(np.int64).max)
        np.minimum.at(low, number, least)
        owner, value = earliest(segments.tolist(), low, limit=limit)
        start = np.searchsorted(owner, np.arange(len(segments)))
        new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])))
        n = np.diff(np.append(new, len(owner)))
        runs = np.searchsorted(owner[new], np.arange(len(segments) + 1))
        per = (runs[1:] - runs[:-1])[number]
        which = np.repeat(np.arange(len(number)), per)
        run_at = np.repeat(runs[:-1][number], per) + np.arange(len(which)) - np.repeat(np.cumsum(per) - per, per)
        keep = value[new[run_at]] < most[which]
        which, run_at = which[keep], run_at[keep]
        out = np.zeros(len(which), FOUND)
        out["id"], out["at"], out["n"], out["least"] = ids[which], new[run_at] - start[number[which]], n[run_at], value[new[run_at]]
        order = np.argsort(chunk[which], kind="stable")
        out, where = out[order], chunk[which][order]
        return _table([(c, KIND_FOUND, out[i:j].tobytes()) for c, i, j in _groups(where)], _SIDE)

    return run


def _removed(docs: pa.Table, side: pa.Table) -> pa.Table:
    """All documents of a chunk with the spans that go and the bytes that stay."""
    c = Chunk(docs, side)
    c.keep_shared()
    found = c.found[np.argsort(c.found["id"], kind="stable")]
    lo, hi = (np.searchsorted(found["id"], c.number, how) for how in ("left", "right"))
    which = np.repeat(np.arange(len(c.number)), hi - lo)
    hit = np.repeat(lo, hi - lo) + np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    later = found["least"][hit] < c.doc_ids[c.owner[which]]
    which, hit = which[later], hit[later]
    begin = c.first[which] + found["at"][hit]
    edge = np.bincount(begin, minlength=len(c.data) + 1) - np.bincount(begin + found["n"][hit] + SPAN - 1, minlength=len(c.data) + 1)
    gone = np.cumsum(edge)[:-1] > 0
    spans, kept = [[] for _ in c.ids], list(c.texts)
    for k in range(len(c.ids)):
        if c.copy[k] and len(c.texts[k]) >= SPAN:
            spans[k], kept[k] = [{"start": 0, "end": len(c.texts[k])}], b""
    for d, k in enumerate(c.rows):
        a, b = int(c.begins[d]), int(c.begins[d] + c.sizes[d])
        mask = gone[a:b]
        if mask.any():
            turns = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist()
            spans[k] = [{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2], strict=True)]
            kept[k] = c.data[a:b][~mask].tobytes()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = [pa.array(c.ids, pa.int64()), pa.array([len(t) for t in c.texts], pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
    return pa.table(columns, ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, limit: int = QUEUE_TUPLES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each document: the byte ranges that go, in order and apart, and the bytes that stay."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = cut(rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n")), "digests")
    n = max(1, -(-(known.agg(F.sum("n")).first()[0] or 0) // chunk_bytes))
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
    first = known.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    later = known.join(first, "digest").where("doc_id > least").select("doc_id", "digest").distinct()
    payload = F.concat(F.unhex(F.lpad(F.hex("doc_id"), 16, "0")), F.col("digest"))
    side = cut(later.select(chunk.alias("chunk"), F.lit(KIND_COPY).alias("kind"), payload.alias("payload")), "copies")
    # Rows without an id take no part and are dealt by their text.
    dealt = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(n)).cast("int")
    texts = in_small_batches(rows.withColumn("chunk", dealt)).groupBy("chunk")
    hashed = texts.cogroup(side.groupBy("chunk")).applyInArrow(_hash_rows(n), HASHED)
    shared = hashed.groupBy("bucket").applyInArrow(_shared_rows, SIDE)
    side = side.union(shared)
    segments = texts.cogroup(side.groupBy("chunk")).applyInArrow(_segment_rows(n), SEGMENTS)
    found = segments.groupBy("shard").applyInArrow(_sorted_rows(limit), SIDE)
    return texts.cogroup(side.union(found).groupBy("chunk")).applyInArrow(_removed, OUT)


def digests(removed: DataFrame) -> DataFrame:
    """Of the result of ``remove_repeats``: sizes, number of spans, and the digest of what stays."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
