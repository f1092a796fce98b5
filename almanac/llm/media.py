"""Media columns: content-defined chunking of payloads into a deduplicated chunk store.

A payload is cut where the top bits of a rolling gear hash are zero, between ``LEAST`` and ``MOST`` bytes. Every
chunk has a SHA-256 digest. A first pass over the texts lists the digests; Spark joins find equal media and
chunks that several media share, and name one owner of each. A second pass writes the chunks,
compressed, with their owner only. Reading back joins a medium's own chunks with the borrowed ones, puts
them in order, checks every digest, and computes features from those bytes.

Media travel through a shuffle only if they borrow chunks; the others are read back where they lie.

Defined cases: a null text is empty and its payload is all padding; rows of equal text share one medium whatever
their doc_id; repeated chunks of one medium are stored once; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import checked_join, cut, in_small_batches

UNIT, PAD, TAIL = 576, b"\xff", 32
LEAST, MOST, CUT_BITS = 512, 16_384, 11
#: The hash depends on this many bytes, as older ones are shifted out of 32 bits.
WINDOW = 32
#: Bytes of lent chunks up to which they are sent to every task instead of being shuffled to their borrowers.
BROADCAST_BYTES = 16 << 20
MAGIC = b"CDC1"

_GEAR = np.random.default_rng(576).integers(0, 1 << 32, 256, np.uint32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """Padded bytes of a text, and the number of bytes before padding."""
    raw = (text or "").encode()
    return raw + PAD * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def cut_ends(payload: bytes) -> list[int]:
    """Ends of the chunks of a payload."""
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    width = 1
    while width < WINDOW:  # h[i] covers bytes i - width + 1 to i
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    marks = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends, start, n = [], 0, len(payload)
    while start < n:
        at = np.searchsorted(marks, start + LEAST)
        end = int(marks[at]) if at < len(marks) else n
        end = min(end, start + MOST, n)
        ends.append(end)
        start = end
    return ends


def chunks_of(payload: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(digest, bytes) of each chunk in order."""
    start = 0
    for end in cut_ends(payload):
        chunk = payload[start:end]
        yield hashlib.sha256(chunk).digest(), chunk
        start = end


def list_chunks(docs: DataFrame) -> DataFrame:
    """First pass: (doc_id, text_key, n_bytes, payload_bytes, digests) of (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                payload, n = payload_of(text)
                rows.append((hashlib.sha256((text or "").encode()).digest(), n, len(payload), [d for d, _ in chunks_of(payload)]))
            out = pd.DataFrame(rows, columns=["text_key", "n_bytes", "payload_bytes", "digests"])
            out.insert(0, "doc_id", b["doc_id"].array)
            yield out

    return in_small_batches(docs).mapInPandas(run, "doc_id long, text_key binary, n_bytes long, payload_bytes long, digests array<binary>")


def decide(listed: DataFrame) -> DataFrame:
    """(text_key, owner, lent, foreign) of the media that have copies or share chunks with others."""
    copies = listed.groupBy("text_key").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).where("n > 1").select("text_key", "owner")
    uses = listed.select("text_key", F.explode("digests").alias("digest"))
    ends = uses.groupBy("digest").agg(F.min("text_key").alias("lender"), F.max("text_key").alias("last")).where("lender < last").select("digest", "lender")
    shared = checked_join(uses, cut(ends, "shared"), "digest", "inner").distinct()
    mine = F.col("text_key") == F.col("lender")
    roles = shared.groupBy("text_key").agg(F.collect_set(F.when(mine, F.col("digest"))).alias("lent"), F.collect_set(F.when(~mine, F.col("digest"))).alias("foreign"))
    return copies.join(roles, "text_key", "full")


def store(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Second pass: (text_key, digests, complete, chunks) of each medium, with its own chunks compressed; a copy is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            rows = []
            for doc_id, text, key, owner, lent, foreign in zip(b["doc_id"], b["text"], b["text_key"], b["owner"], b["lent"], b["foreign"], strict=True):
                if owner == owner and owner is not None and doc_id != owner:
                    continue
                lent, foreign, own, digests = set(lent if lent is not None else ()), set(foreign if foreign is not None else ()), {}, []
                for digest, chunk in chunks_of(payload_of(text)[0]):
                    digests.append(digest)
                    if digest not in foreign and digest not in own:
                        own[digest] = {"digest": digest, "bytes": pack(chunk), "lent": digest in lent}
                rows.append((key, digests, not foreign, list(own.values())))
            yield pd.DataFrame(rows, columns=["text_key", "digests", "complete", "chunks"])

    keyed = docs.select("doc_id", "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_key"))
    held = 100 + 50 * sum(F.coalesce(F.size(c), F.lit(0)) for c in ("lent", "foreign"))  # a decision lists all shared digests of a medium
    return in_small_batches(checked_join(keyed, decisions, "text_key", "left", size=held)).mapInPandas(run, "text_key binary, digests array<binary>, complete boolean, chunks array<struct<digest: binary, bytes: binary, lent: boolean>>")


def stored_form(digests: list[bytes], parts: list[bytes]) -> bytes:
    """A medium by itself: chunk count, (digest, length) of each, then the samples."""
    head = MAGIC + struct.pack("<I", len(parts)) + b"".join(d + struct.pack("<I", len(p)) for d, p in zip(digests, parts, strict=True))
    return head + b"".join(parts)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        rows = []
        for key, digests, chunks, borrowed in zip(b["text_key"], b["digests"], b["chunks"], b["borrowed"], strict=True):
            found = {bytes(c["digest"]): unpack(c["bytes"]) for part in (chunks, borrowed) if part is not None for c in part}
            digests = [bytes(d) for d in digests]
            for d, chunk in found.items():
                if hashlib.sha256(chunk).digest() != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
            parts = [found[d] for d in digests]
            payload, media = b"".join(parts), stored_form(digests, parts)
            counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
            p = counts[counts > 0] / len(payload)
            mean = float(counts @ np.arange(256)) / len(payload)
            text = f"chunks={len(parts)};distinct={len(found)};mean={mean:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f}"
            rows.append((key, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), text))
        yield pd.DataFrame(rows, columns=["text_key", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read_back(stored: DataFrame) -> DataFrame:
    """Features of every stored medium, from its chunks as read back and verified."""
    whole = stored.where("complete").select("text_key", "digests", "chunks", F.lit(None).cast("array<struct<digest: binary, bytes: binary>>").alias("borrowed"))
    parts = stored.where("not complete")
    lent = stored.select(F.explode("chunks").alias("c")).where("c.lent").groupBy("c.digest").agg(F.first("c.bytes").alias("bytes"))
    lent = cut(lent, "lent")  # written, so that Spark may split a chunk that many media borrow
    if (lent.agg(F.sum(F.length("bytes") + 100)).first()[0] or 0) <= BROADCAST_BYTES:
        lent = F.broadcast(lent)
    own = F.transform("chunks", lambda c: c["digest"])
    wanted = parts.select("text_key", F.explode(F.array_except("digests", own)).alias("digest"))
    borrowed = wanted.join(lent, "digest").groupBy("text_key").agg(F.collect_list(F.struct("digest", "bytes")).alias("borrowed"))  # at most the medium's chunks
    parts = parts.select("text_key", "digests", "chunks").join(borrowed, "text_key", "left")
    schema = "text_key binary, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return in_small_batches(whole).mapInPandas(_read, schema).union(parts.mapInPandas(_read, schema))


def chunked_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), one row per row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    listed = cut(list_chunks(docs), "listed")
    stored = cut(store(docs, cut(decide(listed), "decisions")), "store")
    read = cut(read_back(stored).dropDuplicates(["text_key"]), "read")
    return listed.drop("digests").join(read, "text_key").drop("text_key")
