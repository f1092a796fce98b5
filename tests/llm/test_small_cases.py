"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import bpe, common, embeddings, langid, licenses, media, mixing, pii, quality, secret_scan, sketches

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, spans string, size string, copies int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(300, 1).split()
    near = base.copy()
    near[5] = "changed"
    texts = [None, "", " \t\n", "one", "one", " ".join(base), " ".join(near), " ".join(base), words(30_000, 2), "é日本 x@y.zz \U0001f600", words(300, 3)]
    texts += ['password = "abcdefghijkl1234"', "pwd: Tr0ub4dor&3xQz", "call +1 (499) 555-6503 or mail bob.smith@mail.example.com now"] * 2
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], 7, "x", "y", "z", 1) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "one two three", "en", "a", 1, "x", "y", "z", 1)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    made = [embeddings.near_duplicates(vectors), sketches.near_duplicates(empty), secret_scan.scan(empty), pii.scan(empty), bpe.round_trip(empty), quality.classify(empty, labels)]
    made += [media.chunked_media(empty), mixing.mix(empty), langid.identify(empty), licenses.scan(empty.withColumn("path", F.lit("/a/b")))]
    assert [df.count() for df in made] == [0] * 10


def brute_components(ids, linked):
    low = {i: i for i in ids}
    while True:
        old = dict(low)
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
        if low == old:
            return low


def shingles(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_equal_brute_force(spark, docs, n):
    extra = []
    r = random.Random(n)
    base = words(120, 9).split()
    for i in range(60):  # a group of near copies around the threshold
        w = base.copy()
        for _ in range(r.randint(0, 9)):
            w[r.randrange(120)] = f"edit{r.random()}"
        extra.append((100 + i, " ".join(w)))
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = sketches.near_duplicates(table, words=n).collect()
    sets = {r.doc_id: shingles(r.text, n) for r in table.collect() if r.doc_id is not None}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = brute_components(sets, linked)
    assert len(got) == table.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), low[r.doc_id], low[r.doc_id] == r.doc_id)


def test_forest_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 16))
    x[300:450] = x[0] + 0.1 * rng.standard_normal((150, 16))  # near copies
    x[450:480] = x[1]  # copies
    label = np.where(np.arange(600) % 50 == 49, 1, 0)
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(600)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, rows[0][1], None), (905, [], 0), (None, rows[0][1], 0), (906, [1.0, 2.0], 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.98 - 1e-12) & (label[:, None] == label[None, :]) & ~np.eye(600, dtype=bool)
    low = brute_components(range(600), [(int(a), int(b)) for a, b in np.argwhere(link) if a < b])
    n, found = link.sum(axis=1), {r.vec_id: r for r in got}
    assert len(got) == 608
    assert sum(found[i].n_links for i in range(600)) >= 0.99 * n.sum() and all(found[i].n_links <= n[i] for i in range(600))
    assert [found[i].component_id for i in range(600)] == [low[i] for i in range(600)]
    assert all(found[i].n_links == 0 and found[i].kept for i in range(900, 907))


def test_forest_finds_every_link_of_a_large_group(spark):
    """Near copies that differ, far more than a leaf, among other vectors: pairs just above and below the similarity too."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((5000, 64))
    x[:3000] = x[0] + np.sqrt(1 / 0.99 - 1) * rng.standard_normal((3000, 64))  # mean cosine 0.99
    x[3000:4000] = x[3000] + np.sqrt(1 / 0.975 - 1) * rng.standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, x[i].tolist(), 0) for i in range(5000)]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    assert want[:3000].sum() > 8_000_000 and want[3000:4000].sum() > 10_000
    assert [got[i] for i in range(5000)] == want.tolist()


def test_secrets(docs):
    got = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert got[11].spans == "assign:0:28" and got[12].n_guess == 1 and got[0].spans == ""
    assert secret_scan.guess_cost("changeme") < 4 < secret_scan.MIN_LOG10_GUESSES < secret_scan.guess_cost("x9$Kq2!mZp7w")
    assert secret_scan.segment("qwerty2019")[1] == [("word", "qwerty"), ("date", "2019")]
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert "abcdefghijkl1234" not in clean[11] and clean[5] == docs.where("doc_id = 5").first().text
    assert secret_scan.redact(docs).columns == docs.columns


def test_secret_values_of_any_length_and_name():
    long = "".join(random.Random(3).choices("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789!$%", k=250))
    strong = "Tr0ub4dor&3xQz!"
    found = {f'private_key = "{long}"': long, f"pwd = {long} more": long, f'DB_PWD = "{strong}"': strong, f'DB_PASSWORD="{strong}"': strong, f'aws_secret_access_key = "{strong}"': strong, 'pin_pwd = "k9$Zq"': "k9$Zq"}
    found['token = "abcdefghijkl1234&rest$Of!it9"'] = "abcdefghijkl1234&rest$Of!it9"  # reaches beyond the base span
    for text, value in found.items():
        assert [text[s:e] for s, e, kind, _ in secret_scan.find(text) if kind == "guess"] == [value]
        assert value[-5:] not in secret_scan.redact_text(text)
    for value in ("x" * 80, "qw" * 300, "x" * 3000, "sssssecret"):  # long placeholders
        assert secret_scan.guess_cost(value) < secret_scan.MIN_LOG10_GUESSES and secret_scan.redact_text(f'pwd="{value}"') == f'pwd="{value}"'
    r = random.Random(5)
    for _ in range(300):
        v = "".join(r.choice("ab") for _ in range(r.randint(1, 30)))
        plain = {(i, u) for i in range(len(v)) for u in range(1, len(v)) if v[i : i + u] == v[i + u : i + 2 * u] and not any(u % d == 0 and v[i : i + d] * (u // d) == v[i : i + u] for d in range(1, u))}
        runs = secret_scan.Repeats(v, len(v))
        got = [(i, u, n) for i in range(len(v)) for u, n in runs.at(i)]
        assert {(i, u) for i, u, _ in got} == plain and all(v.startswith(v[i : i + u] * n, i) and not v.startswith(v[i : i + u] * (n + 1), i) for i, u, n in got)


def brute_cost(value):
    """Least cost over all segmentations, with any number of parts, without pruning."""
    low = value.lower()
    per_char, runs = np.log10(secret_scan._class_size(value)), secret_scan.Repeats(value, len(value))
    steps = {i: [(i + 1, "brute", per_char)] + list(secret_scan.parts_at(value, low, low.translate(secret_scan.LEET), runs, i, per_char, secret_scan.RANK)) for i in range(len(value))}
    best = np.inf

    def walk(i, cost, parts, is_open):
        nonlocal best
        if i == len(value):
            best = min(best, cost + secret_scan.LOG10_FACTORIAL[parts])
            return
        for end, kind, more in steps[i]:
            walk(end, cost + more, parts + (not (kind == "brute" and is_open)), kind == "brute")

    walk(0, 0.0, 0, False)
    return best


def test_guess_cost_equals_brute_force():
    r = random.Random(8)
    for _ in range(150):
        v = "".join(r.choice(["pass", "key", "12", "aa", "2019", "qwe", "x", "$", "K"]) for _ in range(r.randint(1, 4)))[:11]
        assert secret_scan.guess_cost(v) == pytest.approx(min(brute_cost(v), secret_scan.MOST_LOG10_GUESSES)), v


def test_secret_base_patterns_equal_plain_ones(spark, docs):
    """All documents of a table and random texts against the patterns as given."""
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))
    r = random.Random(2)
    made = ["".join(r.choice(["token", "=", ": ", '"', "AKIA", "ABCD1234", "abc0123", "Secret", "api_key", " ", "\n", "é", "0123456789abcdef"]) for _ in range(r.randint(1, 40))) for _ in range(2000)]
    table = docs.select("doc_id", "text").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    table = table.union(spark.createDataFrame(list(enumerate(made, 10_000)), "doc_id long, text string")).where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in secret_scan.scan(table).collect()}
    rows = table.collect()
    assert len(got) == len(rows)
    for row in rows:
        spans = [(m.start(), n, k, m.end()) for n, (k, pattern, group, least) in enumerate(kinds) for m in pattern.finditer(row.text or "") if len(m[group]) >= least]
        want = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        assert got[row.doc_id].base == want
        assert [x for x in got[row.doc_id].spans.split(",") if x and not x.startswith("guess")] == [x for x in want.split(",") if x]


def test_secrets_in_long_texts_take_linear_time():
    import time

    began = time.perf_counter()
    n = 100_000
    assert len(secret_scan.find("pwd: changeme\n" * n)) == 0
    assert len(secret_scan.find('token = "x9$Kq2!mZp7w" 0123456789abcdef0\n' * 10_000)) == 20_000
    for value in ("x" * 1_000_000, "ab1" * 300_000, "".join(random.Random(1).choices("abcdefghijk$%123XYZ", k=1_000_000))):
        secret_scan.find(f"pwd={value}")
    assert time.perf_counter() - began < 60


def test_words_of_the_corpus_are_cheap(spark):
    table = spark.createDataFrame([(i, f"correct horse battery staple {i}") for i in range(3)] + [(9, None)], "doc_id long, text string")
    rank = secret_scan.dictionary(table)
    assert rank["battery"] == len(secret_scan.RANK) + 1 and secret_scan.dictionary(table, 2).get("horse") is None
    assert secret_scan.guess_cost("correcthorsebatterystaple", rank) < 13 < secret_scan.guess_cost("correcthorsebatterystaple")


def test_pii(spark, docs):
    text = "call +1 (499) 555-6503 or mail bob.smith@mail.example.com now 10.0.0.1 300.1.1.1 and 4111 1111 1111 1111 a@@b.c d@e-.f.g"
    spans = [f"{pii.KINDS[k]}:{text[s:e]}" for s, e, k in pii.base_spans(text)]
    assert spans == ["phone:+1 (499) 555-6503", "email:bob.smith@mail.example.com", "ip:10.0.0.1", "card:4111 1111 1111 1111", "email:d@e-.f.g"]
    r = random.Random(0)
    for _ in range(3000):
        s = "".join(r.choice("ab@.-+ 1") for _ in range(30))
        assert list(pii.emails(s)) == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)], s
    plain = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))

    def fits(kind, x):
        digits = re.sub("[^0-9]", "", x)
        return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in x.split(".")) or kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15

    def by_patterns(s):
        return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted((m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(plain) for m in re.finditer(p, s) if fits(kind, m[0]))]

    for alphabet in ("ab@.-+ 1", "0123456789 -", "12.0", "+1 ()-.4", "4 1-"):
        for _ in range(2000):
            s = "".join(r.choice(alphabet) for _ in range(r.choice((10, 30, 60))))
            assert [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in pii.base_spans(s)] == by_patterns(s), s
    table = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id") + 1000, "text"))
    found = {r.doc_id: r for r in pii.scan(table).collect()}
    for row in table.collect():
        want = by_patterns(row.text or "")
        assert found[row.doc_id].base == ",".join(want) and [x for x in found[row.doc_id].spans.split(",") if x and not x.startswith("term")] == want
    got = {r.doc_id: r for r in pii.scan(docs).collect()}
    assert got[13].n_email == 1 and got[13].n_term > 0 and got[5].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "bob" not in clean[13] and "[TERM]" in clean[13] and clean[5] == docs.where("doc_id = 5").first().text


def test_long_texts_of_digits_take_linear_time():
    import time

    began = time.perf_counter()
    for text in ("1" * 1_000_000, "1." * 500_000, "12 " * 300_000, "+1-" * 300_000, "1@" * 500_000, "a@b" * 300_000, "+" * 1_000_000):
        pii.base_spans(text)
    assert len(pii.base_spans("10.0.0.1 " * 100_000)) == 100_000
    assert time.perf_counter() - began < 60


def test_disclosing_terms_equal_brute_force(spark):
    """Co-occurrence over whole texts, copies, and terms of letters that change their number in lower case."""
    r = random.Random(6)
    pool = [f"w{c}{d}x" for c in "abcdefg" for d in "hijk"] + ["İstanbul", "ÉCLAIR"]
    people = [f"p{i}@mail.org" for i in range(6)]
    texts = []
    for i in range(160):
        words = r.sample(pool, r.randint(1, 6))
        if i % 3 == 0:
            k = r.randrange(6)
            words += [people[k], *[f"friend{'abcdef'[k]}"] * r.randint(0, 1), "far " * 40 + f"Boss{'abcdef'[k]}"]
        texts.append(" ".join(words))
    texts += [texts[0]] * 5 + [None, "", "frienda alone"]
    table = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, terms int")
    held = [({pii.entity_key(k, t[s:e]) for s, e, k in pii.base_spans(t)}, {m[0].lower() for m in pii.terms_of(t, pii.base_spans(t))}) if t else (set(), set()) for t in texts]
    n, want = len(texts), set()
    for entity in {x for e, _ in held for x in e}:
        n_e = sum(entity in e for e, _ in held)
        for term in {x for _, t in held for x in t}:
            n_t, both = sum(term in t for _, t in held), sum(entity in e and term in t for e, t in held)
            if 2 <= n_e < n and both >= 2 and np.log2(n * both / (n_e * n_t)) / np.log2(n / n_e) >= 0.8:
                want.add(term)
    found = {x.term for x in pii.disclosing_terms(table, pii.read_texts(table)).collect()}
    assert found == want and any(t.startswith("boss") for t in want)
    got = {x.doc_id: x for x in pii.scan(table).collect()}
    for i, t in enumerate(texts):
        spans = pii.base_spans(t) + [(m.start(), m.end(), 4) for m in pii.terms_of(t, pii.base_spans(t)) if m[0].lower() in want] if t else []
        assert got[i].spans == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])))
    clean = {x.doc_id: x for x in pii.sanitise(table).collect()}
    assert len(clean) == n and not any(w in (x.text or "").lower() for x in clean.values() for w in want) and clean[3].key == "c"


def test_bpe(spark, docs):
    import public_tokenizers
    import tiktoken

    v = bpe.vocabulary()
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    r = random.Random(4)
    texts = ["".join(r.choice(alphabet) for _ in range(n)) for alphabet in ("ab", "a", "é日 x1 \x1c", "'sS the\n") for n in (1, 7, 300, 20_000)]
    assert [list(x) for x in v.encode_all(texts)] == [known.encode_ordinary(t) for t in texts]
    got = bpe.round_trip(docs).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        ids = known.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert all(back[i] == t.encode() for i, t in text.items())


def test_media(docs):
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = media.chunked_media(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        raw = text[r.doc_id].encode()
        padded = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert len({r.media_sha256 for r in got if r.doc_id in (5, 7)}) == 1
    a = media.payload_of(words(3000, 8))[0]
    shared = {d for d, _ in media.chunks_of(a)} & {d for d, _ in media.chunks_of(a[:700] + b"inserted" + a[700:])}
    assert len(shared) > 0.7 * len(list(media.chunks_of(a)))


@pytest.mark.parametrize("most", [16 << 20, 0])
def test_media_that_share_chunks(spark, monkeypatch, most):
    """Borrowed chunks, broadcast or shuffled; the stored form and features recomputed from the texts; a damaged chunk is found."""
    monkeypatch.setattr(media, "BROADCAST_BYTES", most)
    common = words(2000, 41)
    texts = [common + words(400, 50 + i) for i in range(4)] + [words(300, 60) + common, common, common, words(20, 61), words(20, 61), None, ""]
    rows = [(i if i != 3 else None, t, "x", "y") for i, t in enumerate(texts)] + [(0, words(30, 62), "x", "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, digest string, bytes string")
    got = media.chunked_media(table).collect()
    assert len(got) == len(rows)
    by_hash = {}
    for _, t, _, _ in rows:
        payload = media.payload_of(t)[0]
        chunks = list(media.chunks_of(payload))
        assert b"".join(c for _, c in chunks) == payload
        form = media.stored_form([d for d, _ in chunks], [c for _, c in chunks])
        counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        p = counts[counts > 0] / len(payload)
        feature = f"chunks={len(chunks)};distinct={len(dict(chunks))};mean={float(counts @ np.arange(256)) / len(payload):.4f};entropy={float(-(p * np.log2(p)).sum()):.4f}"
        by_hash[hashlib.sha256(payload).hexdigest()] = (len(form), hashlib.sha256(form).hexdigest(), feature)
    assert all((r.media_bytes, r.media_sha256, r.feature) == by_hash[r.payload_sha256] for r in got)
    docs = table.select("doc_id", "text")
    stored = media.store(docs, media.decide(media.list_chunks(docs)))
    n = stored.select(F.explode("chunks.digest").alias("d")).agg(F.count("*").alias("n"), F.count_distinct("d").alias("k")).first()
    assert n.n == n.k and stored.where("not complete").count() >= 3
    broken = stored.withColumn("chunks", F.transform("chunks", lambda c: c.withField("digest", F.unhex(F.sha2("text_key", 256)))))
    with pytest.raises(Exception, match="damaged"):
        media.read_back(broken).collect()


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.source_size, r.target)
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.target <= 3 * r.source_size
    assert sum(sizes.values()) == pytest.approx(sum(r.size for r in got))
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.taken // r.size for r in got if r.size) + sum(1 for r in taken.collect() if not mixing_size(r.text))


def mixing_size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_language_id(spark, docs):
    rows = []
    for i in range(120):
        r = random.Random(i)
        lang, pool = (("aa", "abcd"), ("bb", "cdef"))[i % 2]
        rows.append((i, " ".join("".join(r.choice(pool) for _ in range(6)) for _ in range(40)), lang))
    rows += [(500, None, "aa"), (501, "123 !!", "aa"), (502, "abab", None), (None, "abab", "aa")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == ("aa", "bb")[i % 2] for i in range(120) if got[i].held_out)
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].lang_pred == "aa"
    assert langid.keep_identified(docs).columns == docs.columns


def kneser_ney(texts, symbols):
    """Interpolated Kneser-Ney by its definition: the probability of z after xy."""
    rows = []
    for t in texts:
        t = re.sub(" +", " ", " " + "".join(c.lower() if c.isalpha() else " " for c in t) + " ")
        rows += [t[i : i + 3] for i in range(len(t) - 2)]
    pairs = {(g[1], g[2]) for g in set(rows)}
    left = {p: len({g[0] for g in set(rows) if (g[1], g[2]) == p}) for p in pairs}
    d = langid.DISCOUNT

    def one(z):
        ends = {c: len({p[0] for p in pairs if p[1] == c}) for c in {p[1] for p in pairs}}
        return max(ends.get(z, 0) - d, 0) / len(pairs) + d * len(ends) / len(pairs) / symbols

    def two(y, z):
        total = sum(n for p, n in left.items() if p[0] == y)
        return one(z) if not total else max(left.get((y, z), 0) - d, 0) / total + d * len({p for p in pairs if p[0] == y}) / total * one(z)

    def three(x, y, z):
        total = sum(g[:2] == x + y for g in rows)
        return two(y, z) if not total else max(rows.count(x + y + z) - d, 0) / total + d * len({g for g in rows if g[:2] == x + y}) / total * two(y, z)

    return three


def test_language_models_equal_kneser_ney_by_definition(spark):
    """Seen and unseen trigrams, contexts and letters, in scripts that share the low bits of their code points."""
    train = {"aa": ["abc abd cab", "bad cab"], "bb": ["абв габ вад", "баб"], "cc": ["日本語 本日", "\U00020001\U00020002日"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in train.items() for t in ts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.build(langid.count_trigrams(table).toPandas())
    letters = {c for ts in train.values() for t in ts for c in t.lower()}
    known = [kneser_ney(train[lang], len(letters) + 1) for lang in model.langs]
    samples = sorted(letters) + ["q", "ж", "語"]
    r = random.Random(0)
    for _ in range(400):
        x, y, z = (r.choice(samples) for _ in range(3))
        if x == y == " " or y == z == " ":
            continue
        key = np.array([ord(x) << 2 * langid.BITS | ord(y) << langid.BITS | ord(z)])
        assert np.exp(model.logs(key)[0]) == pytest.approx([k(x, y, z) for k in known]), (x, y, z)
    for k in known:  # probabilities of what may follow sum to 1
        assert sum(k("a", "b", z) for z in sorted(letters)) + k("a", "b", "~") == pytest.approx(1)


def test_language_id_in_odd_cases(spark):
    """Long texts, clashing columns, repeated rows, ties, and no training rows."""
    rows = [(i, ("abca bcab " if i % 2 else "xyzx zyxz ") * 20, "ab" if i % 2 else "xy", "c", 1.0) for i in range(60)]
    rows += [rows[0], (700, "xyzx zyxz " * 100_000, None, "c", 1.0), (701, "", None, "c", 1.0), (702, "?!", "xy", "c", 1.0), (703, "日本語文字 " * 30, None, "c", 1.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r.doc_id: r for r in langid.identify(table).collect()}
    assert langid.identify(table).count() == len(rows) and got[700].lang_pred == "xy" and got[701].lang_pred == got[702].lang_pred == "und"
    assert got[703].rejected and got[703].lang_pred in ("ab", "xy") and not got[700].rejected
    none = langid.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in none} == {("und", 0.0, True)}
    kept = langid.keep_identified(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {701, 702, 703}


@pytest.mark.parametrize("copies", [1, 100])
def test_secrets_of_letters_keep_their_cost_in_the_corpus(spark, copies):
    """The values are part of the corpus that the ranks come from, alone, in copies and in near copies."""
    prose = "plain words of a corpus that many texts share with each other"
    rows = [(i, f"{prose} {i}") for i in range(50)]
    rows += [(100 + i, f'{prose} pwd = "zqxjvkwplmtr" and auth: "hxqvkzwbnmpl" end') for i in range(copies)]
    rows += [(300 + i, f'{prose} {i} token: qvxzjkwplmtb, 0123456789abcdefabcdef') for i in range(copies)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    rank = secret_scan.dictionary(table)
    assert "corpus" in rank and not {"zqxjvkwplmtr", "hxqvkzwbnmpl", "qvxzjkwplmtb", "abcdefabcdef"} & set(rank)
    got = {r.doc_id: r for r in secret_scan.scan(table).collect()}
    assert got[100].n_guess == 2 and got[300].n_guess == 1 and got[0].n_guess == 0 and got[100].max_log10_guesses > 16
    clean = {r.doc_id: r.text for r in secret_scan.redact(table).collect()}
    assert not any(v in t for t in clean.values() for v in ("zqxjvkwplmtr", "hxqvkzwbnmpl", "qvxzjkwplmtb")) and clean[0] == rows[0][1]


def test_stages_on_empty_tables_and_languages_without_letters(spark, empty):
    assert [f(empty).count() for f in (langid.keep_identified, sketches.keep_one, secret_scan.redact, mixing.take, pii.sanitise)] == [0] * 5
    assert all(f(empty).columns == empty.columns for f in (langid.keep_identified, sketches.keep_one, secret_scan.redact, mixing.take))
    rows = [(i, words(60, i), "aa") for i in range(30)] + [(100 + i, "12 34 -- !?", "xx") for i in range(30)] + [(200, "", "yy"), (201, None, "zz")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(table).collect()}
    assert len(got) == 62 and all(got[i].lang_pred == "und" for i in (*range(100, 130), 200, 201)) and got[0].lang_pred == "aa"
    assert {r.doc_id for r in langid.keep_identified(table).collect()} <= set(range(30))
    none = table.where("doc_id >= 100")
    assert {r.lang_pred for r in langid.identify(none).collect()} == {"und"} and langid.keep_identified(none).count() == 0


def test_quality(spark, docs):
    rows = [(i, words(50, i) if i % 2 else words(50, i).replace(" ", " *** "), i % 2) for i in range(400)]
    table = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(table, labels).collect()}
    assert all(got[i].predicted == i % 2 for i in range(400)) and 0 <= got[900].score <= 1
    assert got[900].score == got[901].score and got[4].held_out == (zlib.crc32(b"4") % 5 == 0)


def test_licenses(spark):
    notice = "Intro text.\nReleased under the MIT License.\nMore words"
    rows = [(1, "/a/LICENSE", notice), (2, "/a/b/c/x.txt", "plain"), (3, "/z/y.txt", None), (4, "/a/b/own.txt", "Licensed under the Apache License, Version 2.0."), (5, None, "x"), (6, "/a/b/c/x.txt", "plain"), (7, "/a/q.txt", "a licensed driver wrote this long sentence about roads and many other things")]
    got = {r.doc_id: (r.license, r.origin, r.licensed_by) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("MIT", "inherited", "/a"), 3: (None, "none", None), 4: ("Apache-2.0", "own", None), 5: (None, "none", None), 6: ("MIT", "inherited", "/a"), 7: ("MIT", "inherited", "/a")}


def test_quality_equals_its_tables_and_odd_cases(spark):
    """Scores by summing tables one text at a time; long texts, clashing columns, repeated ids, labels of one kind and none."""
    rows = [(i, words(30, i) if i % 2 else words(30, i).upper(), "c", 0.5) for i in range(300)]
    rows += [rows[1], (1, "another text of an id", "c", 0.5), (700, "word " * 400_000, "c", 0.5), (701, None, "c", 0.5), (None, "no id", "c", 0.5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, x string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    model = quality.train(table, labels)
    got = quality.classify(table, labels).collect()
    text = {r[0]: r[1] for r in rows if r[0] not in (1, None)}

    def by_hand(x):
        total = model.base
        for f, (edges, t) in enumerate(zip(model.edges, model.tables, strict=True)):
            total += t[sum(e <= x[f] for e in edges)] if len(t) else 0
        for i, j, a, b, t in model.pairs:
            total += t[sum(e <= x[i] for e in a), sum(e <= x[j] for e in b)]
        return 1 / (1 + np.exp(-total))

    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in text:
            assert r.score == pytest.approx(by_hand(quality.features(text[r.doc_id]))) and r.predicted == int(r.score >= 0.3)
    for some, want in ((labels.where("quality = 1"), 0.999), (labels.limit(0), 0.5)):
        assert {round(r.score, 6) for r in quality.classify(table, some).collect()} == {want}


HEADS = {
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n",
    "LGPL-3.0": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n",
    "LGPL-2.1": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright (C) 1991, 1999 Free Software Foundation, Inc.\n",
    "AGPL-3.0": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n",
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n",
    "MIT": "MIT License\n\nCopyright (c) 2024 A Person\n\n" + licenses.TEXTS[2][1],
    "ISC": "Copyright 2024 A Person\n\n" + licenses.TEXTS[3][1],
    "BSD-2-Clause": "Copyright (c) 2024, A Person\nAll rights reserved.\n\n" + licenses.TEXTS[0][1],
    "BSD-3-Clause": "Copyright (c) 2024, A Person\nAll rights reserved.\n\n" + licenses.TEXTS[1][1],
}
HEADERS = {
    "GPL-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\nimport os\n",
    "GPL-2.0": "/* This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n */\nint x;\n",
    "Apache-2.0": '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\nint x;\n',
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\n",
}


def test_licence_files_headers_and_identifiers(spark):
    """Real heads of licence files, wrapped headers, and every identifier and template by itself."""
    rows = [(None, f"/files/{k}/LICENSE", t, k) for k, t in HEADS.items()] + [(None, f"/source/{k}.c", t, k) for k, t in HEADERS.items()]
    rows += [(i, f"/ids/{name}.py", f"# SPDX-License-Identifier: {name}\nx = 1\n", k) for i, (k, names) in enumerate(licenses.IDENTIFIERS.items()) for name in names]
    rows += [(i, f"/templates/{i}.txt", f"Words before.\n{t}\n", k) for i, (k, t) in enumerate(licenses.NOTICES)]
    rows += [(1, "/one/LICENSE", HEADS["MIT"], "MIT"), (1, "/two/own.txt", "a text without any", None), (1, "/one/own.txt", None, "MIT"), (None, "/one/sub/none.txt", "", "MIT")]
    table = spark.createDataFrame([(*r[:3], "x", "y", 1) for r in rows], "doc_id long, path string, text string, license string, key string, folder int")
    got = {r.path: r.license for r in licenses.scan(table).collect()}
    assert got == {r[1]: r[3] for r in rows}


def test_names_decide_between_licences(spark):
    """Licences that are near another's text in all but the name, those without a template, and versions that nobody named."""
    cases = [
        ("Released under the proprietary license", None),
        ("Released under the Apache License", None),
        ("Released under the Python license", None),
        ("Licensed under the GNU General Public License", None),
        ("licensed under the GNU General Public License, version 4", None),
        ("Licensed under the Eclipse Public License, version 2.0", "EPL-2.0"),
        ("Eclipse Public License - v 1.0", "EPL-1.0"),
        ("GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991", "LGPL-2.0"),
        ("Licensed under CC BY 4.0", "CC-BY-4.0"),
        ("Creative Commons Attribution-ShareAlike 4.0 International Public License", "CC-BY-SA-4.0"),
        ("SPDX-License-Identifier: CC-BY-ND-4.0", "CC-BY-ND-4.0"),
        ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
        ("CC0 1.0 Universal", "CC0-1.0"),
        ("// Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
        ("This file is licensed under the zlib License.", "Zlib"),
        ("SPDX-License-Identifier: 0BSD", "0BSD"),
        ("licensed under the Artistic License 2.0", "Artistic-2.0"),
        ("SPDX-License-Identifier: WTFPL", "WTFPL"),
        ("This program is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("The MIT License", "MIT"),
    ]
    rows = [(i, f"/{i}/x.txt", f"Some words.\n{t}\nAnd more of them.") for i, (t, _) in enumerate(cases)]
    rows += [(900 + i, f"/w{i}/LICENSE", f"Copyright (c) 2020 A Person\n\n{t}") for i, (_, t) in enumerate(licenses.TEXTS)]
    got = {x.doc_id: x.license for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {t: got[i] for i, (t, _) in enumerate(cases)} == dict(cases)
    assert [got[900 + i] for i in range(len(licenses.TEXTS))] == [k for k, _ in licenses.TEXTS]


def test_licence_cosines_equal_brute_force(spark):
    """Each sentence's best cosine by its definition."""
    n = len(licenses.TEMPLATES)
    count = lambda t: {w: t.count(w) for w in t}
    vectors = [(k, count(re.findall("[a-z0-9]+", t.lower()))) for k, t in licenses.TEMPLATES]
    df = {w: sum(w in v for _, v in vectors) for _, v in vectors for w in v}
    idf = lambda w: np.log((1 + n) / (1 + df.get(w, 0))) + 1
    weigh = lambda v: {w: c * idf(w) for w, c in v.items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    allows = {k: {w for j, v in vectors if j == k for w in v if w in licenses.DECIDING} for k, _ in vectors}
    r = random.Random(4)
    pool = sorted(set(df) - set(licenses.DECIDING)) + ["road", "car", "eclipse", "3"]
    rows = [(i, f"/d/{i}.txt", "license " + " ".join(r.choice(pool) if r.random() < 0.4 else w for w in r.choice(licenses.NOTICES)[1].replace(".", "").split())) for i in range(60)]
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for i, _, text in rows:
        own = weigh(count(re.findall("[a-z0-9]+", text.lower())))
        decides, best = {w for w in own if w in licenses.DECIDING}, {}
        for k, v in vectors:
            if {w for w in v if w in licenses.DECIDING} <= decides <= allows[k]:
                best[k] = max(best.get(k, 0), round(sum(own.get(w, 0) * x for w, x in weigh(v).items()) / norm(own) / norm(weigh(v)), 9))
        top = sorted((x for x in best.values() if x >= 0.5), reverse=True) + [0, 0]
        named = top[0] >= licenses.SURE_COSINE or top[0] - top[1] >= licenses.MARGIN
        assert (got[i].cosine or 0) == pytest.approx(top[0] if named else 0, abs=1e-6)
    assert sum(x.cosine is not None for x in got.values()) > 5


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "mix", "bpe"]
    assert set(got.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and 100 < got.select("doc_id").distinct().count() <= 200


def test_pipeline_equals_brute_force(spark):
    """Every stage by itself in plain Python or SQL, one after the other, against the rows of the whole."""
    import duckdb
    import pandas as pd
    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from almanac.llm import queries

    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    learn = [r for r in rows if r["lang"] and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    keys = {}
    for r in learn:
        t = re.sub(" +", " ", " " + "".join(c.lower()[0] if c.isalpha() else " " for c in r["text"]) + " ")
        for i in range(len(t) - 2):
            k = (r["lang"], ord(t[i]) << 42 | ord(t[i + 1]) << 21 | ord(t[i + 2]))
            keys[k] = keys.get(k, 0) + 1
    model = langid.build(pd.DataFrame([(a, b, n) for (a, b), n in keys.items()], columns=["lang", "trigram", "n"]))
    h, n = model.entropies([r["text"] for r in learn])
    own = np.array([model.langs.index(r["lang"]) for r in learn])
    mean = np.array([np.average(h[own == i, i], weights=n[own == i]) for i in range(len(model.langs))])
    dev = np.array([max(np.average(h[own == i, i] ** 2, weights=n[own == i]) - mean[i] ** 2, 1e-4) ** 0.5 for i in range(len(model.langs))])
    h, n = model.entropies([r["text"] or "" for r in rows])
    best = h.argmin(axis=1)
    bad = (n == 0) | (h.min(axis=1) > mean[best] + langid.REJECT_SIGMAS * (dev[best] + 2 / np.sqrt(np.maximum(n, 1))))
    rows = [r for r, gone in zip(rows, bad, strict=True) if not gone]

    sets = {r["doc_id"]: shingles(r["text"], 5) for r in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = brute_components(sets, linked)
    rows = [r for r in rows if low[r["doc_id"]] == r["doc_id"]]

    counts, texts = {}, {r["text"] for r in rows if r["text"] is not None}
    for t in texts:
        plain = secret_scan.CONTEXT.sub(" ", t)
        for w in set(re.findall("[a-z]{3,24}", secret_scan.HEX.sub(" ", secret_scan.ASSIGN.sub(" ", plain)).lower())):
            counts[w] = counts.get(w, 0) + 1
    assert len(counts) <= secret_scan.DICTIONARY and len(texts) < 10_000
    rank = dict(secret_scan.RANK)
    for w in sorted(counts, key=lambda w: (-counts[w], w)):
        if counts[w] >= secret_scan.LEAST_TEXTS:
            rank.setdefault(w, len(rank) + 1)
    for r in rows:
        r["text"] = secret_scan.redact_text(r["text"], rank)

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows))
    sizes = con.sql(queries.ORACLES["op8_source_mixing"]).df()
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary().ranks, special_tokens={})
    text, want = {r["doc_id"]: r["text"] or "" for r in rows}, []
    for r in sizes.itertuples():
        ids = known.encode_ordinary(text[r.doc_id])
        row = (r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
        if r.size:  # documents without a word are taken as their source's rule says, which their sizes don't show
            want += [row] * int(r.taken // r.size)
    got = [tuple(r) for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    empty = {r.doc_id for r in sizes.itertuples() if not r.size}
    assert len(want) > 100 and sorted(r for r in got if r[0] not in empty) == sorted(want)


def test_keep_one_drops_copies_alone(spark, docs):
    """Rows without an id beside a repeated id, and two texts under one id, one of them a copy of another document."""
    a, b, c = words(50, 21), words(50, 22), words(50, 23)
    rows = [(1, a), (1, a), (2, a), (2, b), (3, c), (4, c), (None, a), (None, a), (None, c), (None, None), (5, None), (6, ""), (6, None)]
    table = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    got = sketches.keep_one(table)
    assert got.columns == table.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (3, c), (None, a), (None, a), (None, c), (None, None), (5, None), (6, ""), (6, None)], key=str)


def test_near_dedup_stage_equals_brute_force(spark):
    import corpus_pipeline

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {r.doc_id: shingles(r.text, 5) for r in table.collect()}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = brute_components(sets, linked)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, "").collect())
    assert linked and got == sorted(i for i in sets if low[i] == i)


def test_differing_finds_every_link_of_a_crowd(spark):
    """Near copies around the wanted similarity, more than a small bucket: no link between components is lost."""
    rng, rows = random.Random(7), []
    base = [f"w{i}" for i in range(60)]
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 3, 4, 5, 6, 8])):
            words[at] = rng.choice([f"x{i}-{at}", f"y{at}"])
        rows.append((i, " ".join(words)))
    sets = {i: set(s.tolist()) for i, s in zip(range(90), sketches.shingle_sets([t for _, t in rows], 2), strict=True)}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Half of the documents form the main component, each other one is its own.
    members = spark.createDataFrame([(0, i, 0 if i % 2 == 0 else i) for i in range(90)], "main long, id long, component long")
    found = {tuple(r) for r in sketches.differing(members, docs, 2, 80).collect()}

    def components(pairs):
        root = {i: 0 if i % 2 == 0 else i for i in sets}
        for a, b in sorted(pairs):
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
        return root

    assert linked and components(found & linked) == components(linked)


def test_seats_meet_in_the_first_shared_leaf(spark):
    """Overlapping leaves, nearly equal large ones included: each pair is compared in its smallest shared leaf, and large repetitions are not."""
    leaves = {-9: range(0, 1500), -4: range(0, 1400), 3: range(300, 1800), 8: range(1700, 1800), 11: range(1200, 1900)}
    within = {i: [(leaf, len(m)) for leaf, m in leaves.items() if i in m] for i in range(1900)}
    lists = spark.createDataFrame([(i, v) for i, v in within.items()], "id long, in array<struct<leaf: long, members: long>>")
    seen = np.zeros((1900, 1900), bool)
    got = embeddings.seats(lists).collect()
    for leaf, members in leaves.items():
        own, others = np.full(1900, -1), {}
        for r in got:
            if r.leaf == leaf:
                own[r.id], others[r.id] = r.own, set(r["with"])
        assert set(others) == set(members)
        earlier = [set(m) for low, m in leaves.items() if low < leaf]
        for i in members:
            first = [j for j in members if not any(i in m and j in m for m in earlier)]
            met = [j for j in first if own[j] in others[i] and own[i] in others[j]]
            assert met == first
            seen[i, first] = True
    assert all(seen[i, j] for i in range(0, 1900, 7) for j in range(1900) if set(dict(within[i])) & set(dict(within[j])))
    assert not any(r["with"] for r in got if r.leaf == -4)  # a leaf inside an earlier one costs nothing


@pytest.mark.parametrize("most", [common.BROADCAST_BYTES, 0])
def test_joins_bounded_in_bytes(spark, monkeypatch, most):
    """Media with shared chunks and texts with terms: the same rows, joined by a broadcast or by a shuffle."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    shared = words(1500, 71)
    rows = [(i, f"{shared} {i} mail a{i % 3}@example.org zork{"abc"[i % 3]}") for i in range(9)] + [(9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.n_bytes for r in media.chunked_media(docs).collect()) == sorted(len((t or "").encode()) for _, t in rows)
    found = {r.doc_id: r for r in pii.scan(docs).collect()}
    assert len(found) == 11 and all(found[i].n_email == 1 and found[i].n_term >= 1 for i in range(9)) and found[9].n_term == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("zork" not in clean[i] and "@" not in clean[i] for i in range(9)) and clean[10] == ""


def test_forest_with_repeated_ids_and_clashing_columns(spark):
    """One vec_id with several vectors: each links by itself, and components carry the smallest vec_id."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(3, a, 1), (5, a, 1), (5, b, 1), (7, b, 1), (9, c, 1), (9, c, 1), (2, c, 2), (2, a, 2)]
    table = spark.createDataFrame([(*r, "x", "y", 1, 2, 3, 4) for r in rows], "vec_id long, embedding array<float>, label int, id string, class string, low int, node int, leaf int, component int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(table).collect())
    assert got == sorted([(3, 1, 3, True), (5, 1, 3, False), (5, 1, 5, True), (7, 1, 5, False), (9, 0, 9, True), (9, 0, 9, True), (2, 0, 2, True), (2, 0, 2, True)])
    assert embeddings.near_duplicates(table.drop("label").withColumn("label", F.lit(None).cast("int"))).where("n_links > 0").count() == 0


def test_repeated_doc_ids_link_all_of_their_texts(spark):
    """(3, A), (5, A), (5, B), (7, B + a word): one group; ids that repeat with equal, empty and null texts, and null ids."""
    a, b = words(60, 31), words(60, 32)
    rows = [(3, a), (5, a), (5, b), (7, b + " more"), (9, b + " more"), (9, None), (11, ""), (11, None), (12, words(9, 33)), (12, words(9, 33)), (None, a), (None, None), (20, words(70, 34)), (21, words(70, 35))]
    got = [(r.doc_id, r.component_id, r.kept) for r in sketches.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()]
    low = {3: 3, 5: 3, 7: 3, 9: 3, 11: 11, 12: 12, 20: 20, 21: 21, None: None}
    assert sorted(got, key=str) == sorted([(i, low[i], i is not None and low[i] == i) for i, _ in rows], key=str)
