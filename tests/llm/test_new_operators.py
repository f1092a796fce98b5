"""Collocations, periodic runs and suffix-sorted removal against brute force, and on odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from almanac.llm import collocations, induced, passages, runs

SCHEMA = "doc_id long, text string, lang string, source string, runs string, chunk string, spans string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "x", "y", "z", 1) for i, t, lang in rows], SCHEMA)


# Periodic runs


def brute_runs(w, least):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, 2 * q):
                best.setdefault((s, i + q), q)
            i = max(i, s + 1)
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda x: (x[0], x[2]))


def word_lists(r):
    n, kind = r.randint(0, 150), r.randint(0, 4)
    if kind == 0:
        return [r.randint(0, 1) for _ in range(n)]
    if kind == 1:
        return ([r.randint(0, 2) for _ in range(r.randint(1, 20))] * 150)[:n]
    if kind == 2:  # no run is left without a neighbour
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    u = [0] * r.randint(1, 4) + [1]  # two periodic stretches that meet out of step
    w = (u * 10)[: r.randint(1, 40)] + (u * 10)[: r.randint(1, 40)]
    return w if kind == 3 else w + w[: r.randint(0, len(w))]


def test_runs_equal_brute_force():
    r = random.Random(1)
    for _ in range(400):
        docs, least = [word_lists(r) for _ in range(r.randint(1, 4))], r.choice([1, 2, 12])
        sizes, flat = np.array([len(d) for d in docs]), np.array([x for d in docs for x in d], np.int64)
        got = list(zip(*(x.tolist() for x in runs.find_runs(flat, sizes, least)), strict=True))
        starts = np.cumsum(sizes) - sizes
        assert got == [(s + o, e + o, q) for d, o in zip(docs, starts.tolist(), strict=True) for s, e, q in brute_runs(d, least)]


def plain_runs(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = runs.planted(doc_id, len(w))
    if at:
        a, p = at
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found, gone = brute_runs(w, 12), set()
    for s, e, q in found:
        gone.update(range(s + q, e))
    best = min(((-(e - s), s, q) for s, e, q in found), default=None)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_documents(spark):
    r = random.Random(2)
    texts = [None, "", " \t\n", "one", "a b " * 50, "é日\x1c 本 x \x0b" * 40, "\n".join(f"w{r.randint(0, 9)}" for _ in range(900)), "x y z " * 4000]
    rows = [(i, t, "en") for i, t in enumerate(texts * 8)] + [(3, texts[4], "en"), (None, texts[4], None)]
    got = sorted(runs.digests(runs.runs(table(spark, rows), runs.planted)).collect(), key=str)
    want = [plain_runs(i, t) for i, t, _ in rows if t is None or len(t) < 20000]
    long = [tuple(x) for x in got if x.length and x.length > 9000]
    assert sorted((tuple(x) for x in got if tuple(x) not in long), key=str) == sorted(want, key=str)
    assert len(long) == 8 and any(x[1:6] == (1, 0, 12000, 3, 4_000_000) for x in long)
    assert runs.digests(runs.runs(table(spark, []))).count() == 0


def test_a_document_is_found_whole_whatever_the_batch(spark, monkeypatch):
    monkeypatch.setattr(runs, "GROUP_WORDS", 10)
    rows = [(i, "a b c d e " * (i % 7), "en") for i in range(30)]
    got = sorted(tuple(x) for x in runs.digests(runs.runs(table(spark, rows), runs.planted)).collect())
    assert got == sorted(plain_runs(i, t) for i, t, _ in rows)


# Collocations


def plain_collocations(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        inside = Counter()
        for p, a in c.items():
            for k in range(2, len(p)) if a >= least else ():
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in c.items():
            if len(p) >= 2 and a >= least and 100 * inside[p] < 80 * a:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"MAP_BITS": 64}, {"GROUP_BYTES": 200}])  # a map that marks everything, and small groups
def test_collocations_equal_brute_force(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(collocations, k, v)
    r = random.Random(4)
    words = ["The", "OF", "new", "york", "É", "日本", "a-b", "x y", "(", "of"]
    rows = [(i, r.choice([" ", "\t "]).join(r.choice(words) + r.choice(["", "", "", ".", ",", "!\n", "\r"]) for _ in range(80)), r.choice(["en", "fr", None, "und"])) for i in range(40)]
    rows += [(100 + i, "New York City hall of the people", "en") for i in range(40)] + [(7, None, "en"), (8, "", None), (9, " . ,", "de"), (None, "new york", "en"), rows[0]]
    got = sorted(tuple(x) for x in collocations.collocations(table(spark, rows), top=25).collect())
    assert got == plain_collocations(rows, top=25) and len({x[0] for x in got}) >= 2
    assert collocations.collocations(table(spark, [])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a = 3 * 10**13
    counts = spark.createDataFrame([("en", 1, "x", a + 1), ("en", 1, "y", a + 2), ("en", 2, "x y", a)], "lang string, n int, phrase string, f long")
    row = collocations.scored(counts).first()
    assert (row.a, row.l, row.r, row.score) == (a, a + 1, a + 2, 2_000_000 * a // (2 * a + 3))


# Suffixes


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])  # one tuple in memory: all queues on disk, and recursion to the end
def test_suffix_order_and_common_prefixes(limit):
    r = random.Random(limit)
    for _ in range(60):
        pieces = []
        for _ in range(r.randint(1, 6)):
            n, letters = r.choice([1, 3, 30, 260]), r.choice([1, 2, 3, 250])
            x = [r.randint(1, letters) for _ in range(n)]
            pieces.append((x[: r.randint(1, 9)] * 300)[:n] if r.random() < 0.4 else x)
            if r.random() < 0.4:
                pieces.append(x[:3] + pieces[0][r.randint(0, len(pieces[0]) - 1) :])
        text = np.array([c for p in pieces for c in [*p, 0]], np.uint8)
        ends, places = np.flatnonzero(text == 0), []
        for found, common in induced.sorted_blocks(text, limit):
            suffixes = [bytes(text[p : ends[np.searchsorted(ends, p)]]) for p in found.tolist()]
            for k in range(1, len(suffixes)):
                a, b = suffixes[k - 1], suffixes[k]
                same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                assert common[k] == min(same, induced.CAP) and (a >= b or same >= induced.CAP)
            places += found.tolist()
        assert sorted(places) == np.flatnonzero(text).tolist()


def test_queues_leave_nothing_behind(tmp_path, monkeypatch):
    monkeypatch.setenv("TMPDIR", str(tmp_path))
    monkeypatch.setattr("tempfile.tempdir", None)
    assert sum(len(p) for p, _ in induced.sorted_blocks(np.frombuffer(b"abracadabra" * 50 + b"\0", np.uint8), 5)) == 550
    assert not list(tmp_path.iterdir())


def plain_removal(rows):
    first, out = {}, []
    for i, t, _ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49) if i is not None else ():
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    for i, t, _ in rows:
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - 49) if i is not None else ():
            if first[b[k : k + 50]] < i:
                gone.update(range(k, k + 50))
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        out.append((i, len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk,limit", [(1 << 22, 1 << 24), (3000, 50)])
def test_removal_equals_brute_force(spark, chunk, limit):
    r = random.Random(6)
    passages_ = ["".join(r.choice("abcdé日 \n") for _ in range(n)) for n in (49, 50, 51, 120, 400)]
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 90))) + (r.choice(passages_) if r.random() < 0.7 else "") + "".join(r.choice("xyz") for _ in range(r.randint(0, 60))), "en") for i in range(60)]
    rows += [(200 + i, rows[3][1] + passages_[4], "en") for i in range(30)]  # a group of copies
    rows += [(300, "-" * 3000, "en"), (-5, "-" * 700 + "ab" * 400, "en"), (301, "ab" * 30, "en"), (302, "\0" * 120, None), (303, "\0" * 120 + "q", None)]
    rows += [(400, None, "en"), (401, "", "en"), (402, "x" * 49, "en"), (403, "x" * 49, "en"), (None, passages_[4], "en"), (None, None, None), rows[3], (3, passages_[4], "en")]
    got = passages.digests(passages.remove_repeats(table(spark, rows), chunk, limit))
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain_removal(rows)


def test_removal_on_an_empty_table_and_its_spans(spark):
    assert passages.remove_repeats(table(spark, [])).count() == 0
    rows = [(1, "p" * 60, "en"), (2, "aé" + "p" * 55 + "b", "en")]
    found = {x.doc_id: x for x in passages.remove_repeats(table(spark, rows)).collect()}
    assert [tuple(s) for s in found[2].spans] == [(3, 58)] and bytes(found[2].kept) == "aéb".encode() and found[1].spans == []


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    data = np.frombuffer(random.Random(3).randbytes(5000), np.uint8)
    whole = passages.least_hashes(data)
    monkeypatch.setattr(passages, "BLOCK", 333)
    assert (passages.least_hashes(data) == whole).all() and len(whole) == 5000 - 49 and len(passages.least_hashes(data[:20])) == 0


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    assert {"op11_collocations", "op12_periodic_runs", "op13_suffix_dedup"} <= set(entry.queries())
