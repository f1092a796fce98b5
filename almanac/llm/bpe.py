"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of byte spans. Merge candidates wait in one bucket per merge rank; a
three-level bitmap marks the buckets in use, and find-first-set down its levels gives the lowest
rank. A merge rewrites the candidates beside it and leaves the old entries in their buckets, where
they are skipped as stale. A pre-token of n bytes takes O(n) merges whatever its length.

Defined cases: null and empty texts have no ids and decode to no bytes; repeated rows are encoded
each by itself; an empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from almanac.llm.common import in_small_batches

#: Pre-tokens whose ids a worker remembers, past which it starts anew, and their characters at most.
CACHE_ENTRIES, CACHE_CHARS = 250_000, 64
#: Characters whose pre-tokens are looked up together.
GROUP_CHARS = 1_500_000
#: Bytes of the longest pre-token that is merged together with others.
SHORT = 64

#: Finds what is not ASCII text, Latin-1 or Latin Extended: there the two ways to write a class agree.
_NOT_LATIN = re.compile("[^\t-\r -~\xa0-\u024f]").search
_LATIN = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe"}


def _latin_split(pattern: str):
    """The pattern for the standard library, which is faster; None for a pattern other than the default."""
    if pattern != public_tokenizers.PATTERN:
        return None
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LATIN[r'\p{L}']}{_LATIN[r'\p{N}']}]")
    for name, chars in _LATIN.items():
        plain = plain.replace(name + "+", f"[{chars}]+")
    return re.compile(plain).findall


class RankQueue:
    """Positions by rank, lowest rank first and lowest position first within a rank."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels = []
        while True:
            ranks = (ranks + 63) // 64
            self.levels.append([0] * ranks)
            if ranks == 1:
                break

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        for level in self.levels:
            bit, rank = 1 << (rank & 63), rank >> 6
            was = level[rank]
            level[rank] = was | bit
            if was:
                break

    def _lowest(self) -> int:
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = (at << 6) | ((word & -word).bit_length() - 1)
        return at

    def pop(self) -> tuple[int, int]:
        """The next (rank, position); something must wait."""
        at = self._lowest()
        bucket = self.buckets[at]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[at]
            self._clear(at)
        return at, position

    def push_all(self, rank: int, positions: np.ndarray) -> None:
        """Add an array of positions; a queue holds arrays or single positions, not both."""
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.push(rank, positions)
        else:
            bucket.append(positions)

    def pop_all(self) -> tuple[int, np.ndarray]:
        """The next rank with all its positions."""
        at = self._lowest()
        bucket = self.buckets.pop(at)
        self._clear(at)
        return at, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)

    def _clear(self, rank: int) -> None:
        for level in self.levels:
            bit, rank = 1 << (rank & 63), rank >> 6
            level[rank] &= ~bit
            if level[rank]:
                break


class Vocabulary:
    """Ranks of a rank file, with the merge loops and a bounded cache of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.top = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * self.top
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.names = [str(i) for i in range(self.top)]
        self.longest = max(map(len, self.ranks))
        self.queue = RankQueue(self.top)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for piece, rank in self.ranks.items():
            for at in range(1, len(piece)):
                left, right = self.ranks.get(piece[:at]), self.ranks.get(piece[at:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()] + [-1], np.int64)
        self._split = regex.compile(pattern).findall
        self._plain = _latin_split(pattern)
        self.cache: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text; texts of Latin letters take an equal pattern of plain character ranges."""
        if self._plain and not _NOT_LATIN(text):
            return self._plain(text)
        return self._split(text)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token of any length."""
        ranks, longest, queue = self.ranks, self.longest, self.queue
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        after, before, waiting = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n

        def offer(left: int, end: int) -> None:
            rank = ranks.get(piece[left:end], -1) if end - left <= longest else -1
            waiting[left] = rank
            if rank >= 0:
                queue.push(rank, left)

        for i in range(n - 1):
            offer(i, i + 2)
        while queue.buckets:
            rank, i = queue.pop()
            if waiting[i] != rank:
                continue
            j = after[i]
            k = after[j]
            after[i], waiting[j] = k, -1
            if k < n:
                before[k] = i
                offer(i, after[k])
            else:
                waiting[i] = -1
            if (p := before[i]) >= 0:
                offer(p, k)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of many short pre-tokens: one queue whose buckets hold positions of all of them.

        The lowest rank of the batch is also the lowest of each pre-token that has it, so a bucket is
        merged at once, at the first position of each pre-token; later positions go back into it.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(ids)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(sizes)
        after[ends - 1] = n  # n: no neighbour
        before[ends - sizes] = n
        owner, ids = np.append(owner, -1), np.append(ids, self.top)
        waiting = np.full(n + 1, -1, np.int64)
        alive = np.ones(n, bool)
        queue = RankQueue(self.top)
        last = len(self.pair_keys) - 1

        def offer(left: np.ndarray) -> None:
            key = ids[left] << 32 | ids[after[left]]
            at = np.minimum(np.searchsorted(self.pair_keys, key), last)
            ranks = np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)
            waiting[left] = ranks
            if (hit := ranks >= 0).any():
                left, ranks = left[hit], ranks[hit]
                if len(left) > 1:
                    order = np.argsort(ranks, kind="stable")
                    left, ranks = left[order], ranks[order]
                    cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                    for rank, group in zip(ranks[np.append(0, cuts)].tolist(), np.split(left, cuts), strict=True):
                        queue.push_all(rank, group)
                else:
                    queue.push_all(int(ranks[0]), left)

        offer(np.arange(n))
        while queue.buckets:
            rank, i = queue.pop_all()
            i = i[waiting[i] == rank]  # else stale
            if len(i) > 1:
                i = np.unique(i)
                first = np.append(True, owner[i[1:]] != owner[i[:-1]])
                if not first.all():
                    queue.push_all(rank, i[~first])
                    i = i[first]
            elif not len(i):
                continue
            j = after[i]
            k = after[j]
            ids[i], after[i], waiting[j], alive[j] = rank, k, -1, False
            before[k] = i
            p = before[i]
            offer(np.concatenate((i, p[p < n])))
        kept = ids[:-1][alive].tolist()
        counts = np.bincount(owner[:-1][alive], minlength=len(pieces))
        out, at = [], 0
        for c in counts.tolist():
            out.append(tuple(kept[at : at + c]))
            at += c
        return out

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; texts are taken in groups of about ``GROUP_CHARS`` characters."""
        group, chars = [], 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars > GROUP_CHARS:
                yield from self._encode_group(group)
                group, chars = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> Iterator[list[int]]:
        tokens = [self.split(t) if t else [] for t in texts]
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        new = set(chain.from_iterable(tokens)).difference(cache)
        short, long = [], {}
        for piece in new:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                cache[piece] = (whole,)
            elif len(piece) > CACHE_CHARS:
                long[piece] = self.merge(raw)
            elif len(raw) > SHORT:
                cache[piece] = self.merge(raw)
            else:
                short.append((piece, raw))
        if short:
            cache.update(zip([p for p, _ in short], self.merge_many([r for _, r in short]), strict=True))
        ids = (ChainMap(long, cache) if long else cache).__getitem__
        for t in tokens:
            yield list(chain.from_iterable(map(ids, t)))

    def encode(self, text: str) -> list[int]:
        return next(self._encode_group([text]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def vocabulary(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    return Vocabulary(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) of whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path, pattern)
        for b in batches:
            ids = list(v.encode_all(b["text"].fillna("").tolist()))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": list(map(len, ids)), "ids": ids})

    return in_small_batches(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, decoded binary) of rows that have ``ids``; null ids decode to no bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "decoded": [v.decode(x) if x is not None else b"" for x in b["ids"]]})

    return in_small_batches(encoded.select("doc_id", "ids")).mapInPandas(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode, decode and digest in one pass: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path, pattern)
        name = v.names.__getitem__
        sha = hashlib.sha256
        for b in batches:
            rows = []
            for ids in v.encode_all(b["text"].fillna("").tolist()):
                rows.append((len(ids), sha(" ".join(map(name, ids)).encode()).hexdigest(), sha(v.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].array)
            yield out

    return in_small_batches(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
