"""Suffixes of a shard in order, with common prefixes, by induced sorting with queues that overflow to disk.

A shard is a text of numbers in which every piece ends with 0. A suffix is of type S if it is less than the next one, else of type
L; a star is an S whose predecessor is an L. Stars are sorted first: the stretches between them get names by their
order, and the shorter text of names is sorted by recursion, until it fits into memory, where doubling ends it. The rest
follows by induction. In ascending order, each suffix gives its predecessor's place among the L with the same first
number; in descending order, the same for the S. A queue keyed by first number holds the suffixes so found until their
turn comes, as tuples of position and common prefix with the one before. It keeps a bounded number of tuples in memory
and writes the rest as runs sorted by key.

The common prefix of two suffixes with the same first number is one more than that of their successors: the least value
between those in the order. Only where stars and induced suffixes meet is it counted in the text. Values end at ``CAP``.
Order beyond a piece's end is left open: suffixes that are equal up to the end of their pieces come in any order.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np

CAP = 200


class DiskQueue:
    """Tuples (position, common prefix) by key: all of a key leave at once, in the order in which they came."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.held = folder, limit, 0
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.runs: list[tuple[np.ndarray, np.ndarray, str]] = []
        self.heap: list[int] = []
        self.known: set[int] = set()

    def push(self, keys: np.ndarray, places: np.ndarray, common: np.ndarray) -> None:
        """Add tuples whose keys are in groups."""
        if not len(keys):
            return
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for key, a, b in zip(keys[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            self.parts.setdefault(key, []).append((places[a:b], common[a:b]))
            if key not in self.known:
                self.known.add(key)
                heapq.heappush(self.heap, key)
        self.held += len(keys)
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        """Write what memory holds as a run in order of keys."""
        keys, ends, total = sorted(self.parts), [0], 0
        path = os.path.join(self.folder, f"run-{id(self)}-{len(self.runs)}")
        with open(path, "wb") as out:
            for key in keys:
                for places, _ in self.parts[key]:
                    out.write(places.astype(np.int64).tobytes())
                    total += len(places)
                ends.append(total)
            for key in keys:
                for _, common in self.parts[key]:
                    out.write(common.astype(np.uint8).tobytes())
        self.runs.append((np.array(keys), np.array(ends), path))
        self.parts, self.held = {}, 0

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for keys, ends, path in self.runs:
            i = int(np.searchsorted(keys, key))
            if i < len(keys) and keys[i] == key:
                a, b, total = int(ends[i]), int(ends[i + 1]), int(ends[-1])
                found.append((np.fromfile(path, np.int64, b - a, offset=8 * a), np.fromfile(path, np.uint8, b - a, offset=8 * total + a)))
        held = self.parts.pop(key, [])
        self.held -= sum(len(p) for p, _ in held)
        found += held
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found])

    def next_key(self) -> int | None:
        """The least key that holds tuples or will be popped next; it is forgotten here."""
        if not self.heap:
            return None
        key = heapq.heappop(self.heap)
        self.known.discard(key)
        return key


class _Least:
    """Least values over ranges of an array of small numbers."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        width = 1
        while 2 * width <= len(values):
            t = self.tables[-1]
            self.tables.append(np.minimum(t[:-width], t[width:]))
            width *= 2

    def over(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of ranges with both ends inside, none empty."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.tables[0].dtype)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            t = self.tables[k]
            out[at] = np.minimum(t[first[at]], t[last[at] - (1 << k) + 1])
        return out


def _stars(text: np.ndarray) -> np.ndarray:
    """Positions of the stars."""
    rises, changes = text[:-1] < text[1:], np.flatnonzero(text[:-1] != text[1:])
    if not len(changes):
        return np.array([len(text) - 1])
    small = np.zeros(len(text), bool)  # type S
    ends = np.append(changes, len(text) - 1)
    small[ends] = np.append(rises[changes], True)
    small = np.repeat(small[ends], np.diff(np.append(-1, ends)))
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _words(text: np.ndarray) -> np.ndarray:
    """Of a text of bytes, the eight bytes from each position, as big-endian numbers to be gathered; 0 beyond its end."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    return np.ndarray(len(text), ">u8", padded, strides=(1,))


def _names(text: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Order numbers of the stretches from each star to the next, both included; one that begins another comes after it. 0 for the ends of pieces."""
    size = np.append(stars[1:] - stars[:-1] + 1, 1)
    size[text[stars] == 0] = 1
    if text.dtype == np.uint8:
        words, step = _words(text), 8

        def part(at: np.ndarray, off: int) -> np.ndarray:
            over = np.maximum(off + 8 - size[at], 0).astype(np.uint64)  # bytes beyond the stretch read as 255
            fill = np.where(over >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.uint64(8) * np.minimum(over, np.uint64(7)))) - np.uint64(1))
            return words[np.minimum(stars[at] + off, len(text) - 1)].astype(np.uint64) | fill
    else:
        step = 1

        def part(at: np.ndarray, off: int) -> np.ndarray:
            return np.where(size[at] > off, text[np.minimum(stars[at] + off, len(text) - 1)], np.iinfo(np.int64).max)

    names = np.unique(part(np.arange(len(stars)), 0), return_inverse=True)[1].astype(np.int64)
    off = step
    while (size > off).any():
        open_ = np.flatnonzero(size >= off)
        open_ = open_[np.isin(names[open_], names[size > off])]  # with those that end here, if others go on
        value = part(open_, off)
        order = np.lexsort((value, names[open_]))
        at, value = open_[order], value[order]
        new_name = np.append(True, names[at[1:]] != names[at[:-1]])
        sub = np.cumsum(np.append(False, (value[1:] != value[:-1]) & ~new_name[1:]))
        first = np.flatnonzero(new_name)
        sub -= np.repeat(sub[first], np.diff(np.append(first, len(at))))
        extra = np.zeros(int(names.max()) + 2, np.int64)
        np.maximum.at(extra, names[at] + 1, sub)
        names = names + np.cumsum(extra)[names]
        names[at] += sub
        off += step
    return names


def _doubled(names: np.ndarray) -> np.ndarray:
    """Positions in order of the suffixes of a text in memory; pieces end with 0."""
    n = len(names)
    last = _piece_ends(names)
    rank, width, before = names, 1, -1
    while True:
        most = int(rank.max())
        if most == before or most == n - 1:
            return np.argsort(rank, kind="stable")
        before = most
        there = np.flatnonzero(np.arange(n) + width <= last)
        follows = np.zeros(n, np.int64)
        follows[there] = rank[there + width] + 1
        rank = _ranked(rank * (most + 2) + follows, (most + 1) * (most + 2))
        width *= 2


def _piece_ends(text: np.ndarray) -> np.ndarray:
    """For each position the end of its piece."""
    ends = np.flatnonzero(text == 0)
    return np.repeat(ends, np.diff(np.append(-1, ends)))


def _ranked(values: np.ndarray, most: int) -> np.ndarray:
    """Order numbers of values from 0 to ``most``, equal ones for equal values. Values are sorted together with their places where both fit into 63 bits."""
    n, bits = len(values), max(1, (len(values) - 1).bit_length())
    if most.bit_length() + bits > 63:
        return np.unique(values, return_inverse=True)[1].astype(np.int64)
    both = np.sort(values << bits | np.arange(n))
    value = both >> bits
    out = np.empty(n, np.int64)
    out[both & ((1 << bits) - 1)] = np.cumsum(np.append(False, value[1:] != value[:-1]))
    return out


class Shard:
    """A text to be sorted; ``limit`` tuples and names are held in memory, the rest in ``folder``."""

    def __init__(self, text: np.ndarray, folder: str, limit: int):
        self.text, self.folder, self.limit = text, folder, limit
        self.end = _piece_ends(text)
        self.words = _words(text) if text.dtype == np.uint8 else None

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes, counted up to ``CAP`` and within their pieces."""
        most = np.minimum(self.end[a] - a, self.end[b] - b)
        most = np.minimum(most, CAP)
        out, live = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            if self.words is not None:
                differ = self.words[x].astype(np.uint64) ^ self.words[y].astype(np.uint64)
                top = np.frexp(differ.astype(np.float64))[1]  # bits up to the highest that differs; rounding may add one
                top -= (differ >> np.maximum(top - 1, 0).astype(np.uint64) == 0) & (differ > 0)
                step = np.where(differ == 0, 8, (64 - top) // 8)
                full = 8
            else:
                step, full = (self.text[x] == self.text[y]).astype(np.int64), 1
            out[live] += step
            live = live[(step == full) & (out[live] < most[live])]
        return np.minimum(out, most)

    def star_order(self, stars: np.ndarray) -> np.ndarray:
        """Stars in order of their suffixes: by recursion on their names, in memory once these fit."""
        names = _names(self.text, stars)
        if len(names) <= self.limit:
            return stars[_doubled(names)]
        ends = np.flatnonzero(names == 0)
        order = np.memmap(os.path.join(self.folder, f"order-{id(names)}"), np.int64, "w+", shape=(len(names),))
        order[: len(ends)], free = ends, len(names)
        for places, _ in Shard(names, self.folder, self.limit).blocks():  # from the last to the first
            order[free - len(places) : free] = places[::-1]
            free -= len(places)
        return stars[order]

    def _rounds(self, key: int, places: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A key's tuples with those that they induce for the same key, again and again."""
        parts, carry = [(places, common)], 0
        while len(places):
            before = places - 1
            hit = np.flatnonzero((places > 0) & (self.text[before] == key))
            if not len(hit):
                break
            # From one parent to the next; the first child follows the last one of the round before.
            upto = np.minimum.reduceat(np.append(common, CAP), np.stack((np.append(0, hit[:-1] + 1), hit + 1), axis=1).ravel())[::2]
            upto = upto.astype(np.int64)
            upto[0] = min(int(upto[0]), carry)
            rest = common[hit[-1] + 1 :]
            carry = int(rest.min()) if len(rest) else CAP
            places, common = before[hit], np.minimum(upto + 1, CAP).astype(np.uint8)
            parts.append((places, common))
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])

    def _induce(self, places: np.ndarray, common: np.ndarray, key: int, up: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a key's finished tuples induce for other keys: (keys, positions, common prefixes), by key."""
        first = self.text[places - 1]
        hit = np.flatnonzero((places > 0) & ((first > key) if up else ((first < key) & (first > 0))))
        keys = first[hit]
        order = np.argsort(keys, kind="stable")
        hit, keys = hit[order], keys[order]
        value = np.ones(len(hit), np.int64)
        same = np.flatnonzero(keys[1:] == keys[:-1]) + 1
        if len(same):
            value[same] = np.minimum(_Least(common).over(hit[same - 1] + 1, hit[same]).astype(np.int64) + 1, CAP)
        return keys, places[hit] - 1, value.astype(np.uint8)

    def _meet(self, places: np.ndarray, common: np.ndarray, more: np.ndarray, common_more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two ordered lists of one key under one another."""
        if len(places) and len(more):
            common_more = common_more.copy()
            common_more[0] = self.common(places[-1:], more[:1])[0]
        return np.concatenate((places, more)), np.concatenate((common, common_more))

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, common prefixes with the position before) in descending order, a block for each first number; ends of pieces are left out."""
        if not len(self.text):
            return
        stars = self.star_order(_stars(self.text))
        common = np.zeros(len(stars), np.int64)
        common[1:] = self.common(stars[:-1], stars[1:])
        heads = self.text[stars]
        seeds, found = DiskQueue(self.folder, self.limit), DiskQueue(self.folder, self.limit)
        seeds.push(heads, stars, np.minimum(common, CAP).astype(np.uint8))
        del stars, common, heads
        large = DiskQueue(self.folder, self.limit)  # the L of each key, for the second pass
        while (key := _least_key(seeds, found)) is not None:
            places, common = self._rounds(key, *found.pop(key))
            if len(places):
                large.push(np.full(len(places), -key), places, common)
            places, common = self._meet(places, common, *seeds.pop(key))
            found.push(*self._induce(places, common, key, True))
        del seeds, found
        small = DiskQueue(self.folder, self.limit)
        while (key := _least_key(large, small)) is not None:
            places, common = self._rounds(-key, *small.pop(key))
            more, common_more = large.pop(key)
            back = np.zeros(len(more), np.uint8)
            back[1:] = common_more[1:][::-1]
            places, common = self._meet(places, common, more[::-1], back)
            keys, before, value = self._induce(places, common, -key, False)
            small.push(-keys.astype(np.int64), before, value)
            yield places, common


def _least_key(*queues: DiskQueue) -> int | None:
    """The least key of queues, taken from all that have it."""
    keys = [q.heap[0] for q in queues if q.heap]
    if not keys:
        return None
    key = min(keys)
    for q in queues:
        if q.heap and q.heap[0] == key:
            q.next_key()
    return key


def sorted_blocks(text: np.ndarray, limit: int = 1 << 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The blocks of a shard: ``text`` holds bytes 1 to 254, every piece ends with 0. At most ``limit`` tuples of a queue, and names, are in memory; the rest is in files of this task, which go with it."""
    with tempfile.TemporaryDirectory() as folder:
        yield from Shard(text, folder, limit).blocks()
