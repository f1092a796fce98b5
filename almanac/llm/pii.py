"""PII: base patterns, and information-theoretic sanitisation of the terms that reveal them.

Emails, addresses, card and phone numbers are protected entities. A term, a word outside the base spans, may reveal an entity
that stands anywhere in the same document: from corpus counts, how much of an entity's information a term
discloses is the pointwise mutual information of both over the entity's own information content,
``log2(N n_both / (n_entity n_term)) / log2(N / n_entity)``, with rows counted over all documents and whole texts. A term that
discloses at least ``DISCLOSURE`` of an entity, in at least ``SUPPORT`` documents with it, is a span of kind ``term`` wherever
it stands, and ``sanitise`` generalises it.

As n_both is at most n_entity, only terms of at most ``n_entity ** d * N ** (1 - d)`` documents can disclose d of it; other
pairs are not formed. Entities, and terms, that occur in the same documents share one group, and groups are paired
instead of their members, so copies of a long list of entities don't become all pairs.

Defined cases: null and empty texts have no spans; rows of equal text have equal spans; spans of one start follow the
order of ``KINDS``; an entity of every document discloses nothing; repeated rows count each; an empty table gives an
empty table; other columns are not read by ``scan`` and are kept by ``sanitise``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import checked_join, cut, in_small_batches

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSURE, SUPPORT = 0.8, 2
#: Slots of the map of wanted terms that each task holds, half a megabyte; terms that share a slot are told apart by a join afterwards.
SLOTS = 1 << 22
#: Rows of terms, or of texts with their terms, that a join may broadcast.
MOST_TERMS = 100_000

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Numbers joined by single dots, and digits joined by single separators: whole chains, so that searching takes linear time.
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses; found from their @, which each has once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping runs of four numbers joined by dots, each at most 255: every four of a chain in turn."""
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in four)):
                yield at, at + size
            at += size + 1


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, by start, then kind."""
    if not text:
        return []
    out = [(s, e, 0) for s, e in emails(text)]
    if _DIGIT.search(text):
        out += [(s, e, 1) for s, e in addresses(text)]
        for m in _DIGITS.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


def entity_key(kind: int, value: str) -> str:
    """A 128-bit name of an entity: letters in lower case, numbers without separators."""
    value = value.lower() if kind == 0 else value if kind == 1 else re.sub("[^0-9]", "", value)
    return xxhash.xxh3_128_hexdigest(f"{KINDS[kind]}:{value}")


def terms_of(text: str, spans) -> Iterator[re.Match]:
    """Words outside the spans."""
    at = 0
    for s, e, _ in spans:
        if s > at:
            yield from _TERM.finditer(text, at, s)
        at = max(at, e)
    yield from _TERM.finditer(text, at)


def distinct_terms(text: str, spans) -> set[str]:
    return set(map(str.lower, set(_TERM.findall(text)))) if not spans else {m[0].lower() for m in terms_of(text, spans)}


def text_key() -> Column:
    """128 bits of a text; null is empty."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def read_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans, entities, terms): base spans of each row; entities and terms, each once, where it has entities."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans, entities, terms = [], [], []
            for text in b["text"]:
                found = base_spans(text)
                spans.append([{"start": s, "kind": k, "end": e} for s, e, k in found])
                entities.append(sorted({entity_key(k, text[s:e]) for s, e, k in found}) if found else None)
                terms.append(sorted(distinct_terms(text, found)) if found else None)
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "key": b["key"].array, "spans": spans, "entities": entities, "terms": terms})

    schema = "doc_id long, key binary, spans array<struct<start: long, kind: int, end: long>>, entities array<string>, terms array<string>"
    return in_small_batches(docs.select("doc_id", text_key().alias("key"), "text")).mapInPandas(run, schema)


class Wanted:
    """The slots of a table of terms as bits, gathered by Spark in words of 64, and a memory of looked-up terms."""

    def __init__(self, terms: DataFrame):
        slot = F.pmod(F.crc32("term"), F.lit(SLOTS))
        words = terms.select((slot / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(pmod(crc32(term), 64) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        self.bits = np.zeros(SLOTS // 64, np.int64)
        rows = words.toPandas()  # at most SLOTS / 64
        self.bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
        self.yes: set[str] = set()
        self.no: set[str] = set()

    def of(self, terms: set[str]) -> set[str]:
        """Those of the terms whose slot is wanted; answers for short terms are kept."""
        left = terms - self.no
        found = left & self.yes
        for term in left - found:
            slot = zlib.crc32(term.encode()) % SLOTS
            hit = bool(int(self.bits[slot >> 6]) >> (slot & 63) & 1)
            if hit:
                found.add(term)
            if len(term) <= 64:
                kept = self.yes if hit else self.no
                if len(kept) > 200_000:
                    kept.clear()
                kept.add(term)
        return found


def document_frequency(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n) rows whose text holds each wanted term outside base spans, counted over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(Wanted(wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = sent.value
        for b in batches:
            counts: Counter[str] = Counter()
            for text in b["text"]:
                if text:
                    counts.update(there.of(distinct_terms(text, base_spans(text))))
            if counts:
                yield pd.DataFrame({"term": list(counts.keys()), "n": list(counts.values())})

    counted = in_small_batches(docs.select("text")).mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return checked_join(counted, wanted, "term", "left_semi", limit=MOST_TERMS)


def _documents_of(name: str) -> list[Column]:
    """What tells the set of documents of a group: its number of rows, and 128 bits of its texts."""
    return [F.sum("copies").alias(f"n_{name}"), F.bit_xor(F.xxhash64("key")).alias(f"{name}_1"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias(f"{name}_2")]


def disclosing_terms(docs: DataFrame, read: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(term, disclosed): the terms that disclose at least the given share of some entity's information, and the greatest share."""
    total = docs.count()
    texts = cut(read.where("entities is not null").groupBy("key").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms")), "entity-texts")
    held = texts.select("key", "copies", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(*_documents_of("entity")).where(f"n_entity >= {support} and n_entity < {total}")
    held = checked_join(held, cut(entities, "entities"), "entity", "inner").drop("entity").distinct()
    held = cut(held, "entity-groups")
    most = held.agg(F.max("n_entity")).first()[0] or 0
    within = checked_join(texts, cut(held.select("key").distinct(), "keys"), "key", "left_semi").select("key", "copies", F.explode("terms").alias("term"))
    terms = cut(within.groupBy("term").agg(*_documents_of("inside")).where(f"n_inside >= {support}"), "terms")
    reach = F.pow(F.col("n_entity").cast("double"), F.lit(disclosure)) * float(max(total, 1)) ** (1 - disclosure)
    few = float(most) ** disclosure * float(max(total, 1)) ** (1 - disclosure)
    frequency = document_frequency(docs, terms.where(F.col("n_inside") <= few).select("term")).where(F.col("n") <= few * (1 + 1e-9))
    terms = cut(terms.join(frequency, "term"), "rare-terms")
    group = ["inside_1", "inside_2", "n_inside", "n"]
    named = checked_join(within, terms, "term", "inner", limit=MOST_TERMS).select("key", *group).distinct()
    pairs = held.join(named, "key").where(F.col("n") <= reach * (1 + 1e-9))
    both = pairs.groupBy("entity_1", "entity_2", "n_entity", *group).agg(F.sum("copies").alias("n_both")).where(f"n_both >= {support}")
    rows = F.lit(float(max(total, 1)))
    share = F.log2(rows * F.col("n_both") / (F.col("n_entity") * F.col("n"))) / F.log2(rows / F.col("n_entity"))
    found = cut(both.withColumn("disclosed", share).where(F.col("disclosed") >= disclosure).groupBy(*group).agg(F.max("disclosed").alias("disclosed")), "disclosing")
    return cut(checked_join(terms, found, group, "inner").select("term", "disclosed"), "disclosing-terms")


def term_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(key, terms: array of (start, end)) of the texts that hold terms of ``found``, every occurrence outside base spans."""
    sent = docs.sparkSession.sparkContext.broadcast(Wanted(found))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = sent.value
        for b in batches:
            rows = []
            for key, text in zip(b["key"], b["text"], strict=True):
                spans = base_spans(text)
                if not (wanted := there.of(distinct_terms(text, spans))):
                    continue
                places: dict[str, list[dict[str, int]]] = {term: [] for term in wanted}
                for m in terms_of(text, spans):
                    if (term := m[0].lower()) in wanted:
                        places[term].append({"start": m.start(), "end": m.end()})
                rows += [(key, term, at) for term, at in places.items()]
            if rows:
                yield pd.DataFrame(rows, columns=["key", "term", "at"])

    seen = in_small_batches(docs).select(text_key().alias("key"), "text").where("text is not null").mapInPandas(run, "key binary, term string, at array<struct<start: long, end: long>>")
    exact = checked_join(seen, found.select("term"), "term", "left_semi", limit=MOST_TERMS)
    each = exact.groupBy("key", "term").agg(F.first("at").alias("at"))  # copies of a text have the same places
    return cut(each.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("terms")), "term-spans")  # a text's own words


def scan(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base, spans) of whole texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = cut(read_texts(docs), "base-spans")
    terms = term_spans(docs, disclosing_terms(docs, read, disclosure, support))
    names = F.array(*map(F.lit, KINDS))

    def of_kind(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")

    out = checked_join(read.select("doc_id", "key", "spans"), terms, "key", "left", limit=MOST_TERMS, size=100 + 24 * F.size("terms"))
    more = F.transform(F.coalesce("terms", F.array().cast("array<struct<start: bigint, end: bigint>>")), lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), x["end"].alias("end")))
    everything = F.array_sort(F.concat("spans", more))
    return out.select(
        "doc_id",
        *(of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])),
        F.size(more).cast("long").alias("n_term"),
        listed(F.col("spans")).alias("base"),
        listed(everything).alias("spans"),
    )


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """The documents with entities and disclosing terms replaced by the name of their kind, all columns kept."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    terms = term_spans(narrow, disclosing_terms(narrow, cut(read_texts(narrow), "base-spans"), disclosure, support))
    terms = terms.select(F.col("key").alias("_pii_key"), F.col("terms.start").alias("_pii_start"), F.col("terms.end").alias("_pii_end"))

    @F.pandas_udf("string")
    def clean(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        done = []
        for text, first, last in zip(texts, starts, ends, strict=True):
            spans = base_spans(text)
            if first is not None:
                spans = sorted(spans + [(int(s), int(e), 4) for s, e in zip(first, last, strict=True)], key=lambda x: (x[0], x[2]))
            out, at = [], 0
            for s, e, k in spans:
                if s >= at:
                    out += [text[at:s], f"[{KINDS[k].upper()}]"]
                at = max(at, e)
            done.append("".join(out) + text[at:] if out else text)
        return pd.Series(done, dtype=object)

    keyed = checked_join(in_small_batches(docs).withColumn("_pii_key", text_key()), terms, "_pii_key", "left", limit=MOST_TERMS, size=100 + 24 * F.size("_pii_start"))
    return keyed.withColumn("text", clean("text", "_pii_start", "_pii_end")).select(*docs.columns)
