"""The registered queries of this subpackage, one per operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import bpe, collocations, embeddings, langid, licenses, media, mixing, passages, pii, quality, runs, secret_scan, sketches


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_rp_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)


def op2_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.near_duplicates(_docs(spark, sf_dir, "doc_id", "text"), words=2, similarity=80)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_docs(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_guess", "max_log10_guesses")


def op4_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(_docs(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_term")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_docs(spark, sf_dir, "doc_id", "text"))


def op6_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.classify(_docs(spark, sf_dir, "doc_id", "text"), labels)


def op7_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.chunked_media(_docs(spark, sf_dir, "doc_id", "text"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir, "doc_id", "text", "source"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(_docs(spark, sf_dir, "doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: 20 to a folder, 20 folders to a group; the first of each is its licence file."""
    docs = _docs(spark, sf_dir, "doc_id", "text", "source")
    group, folder = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("none")), F.expr("doc_id div 400")), F.expr("doc_id div 20 % 20")
    path = F.when(F.expr("doc_id % 400 = 0"), F.concat_ws("/", group, F.lit("LICENSE"))).when(F.expr("doc_id % 20 = 0"), F.concat_ws("/", group, folder, F.lit("LICENSE")))
    return licenses.scan(docs.withColumn("path", path.otherwise(F.concat(F.concat_ws("/", group, folder, F.col("doc_id")), F.lit(".txt")))))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_docs(spark, sf_dir, "text", "lang"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.runs(_docs(spark, sf_dir, "doc_id", "text"), runs.planted))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digests(passages.remove_repeats(_docs(spark, sf_dir, "doc_id", "text")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_rp_forest_dedup,
        op2_setsketch_dedup,
        op3_secret_scan,
        op4_pii_disclosure,
        op5_bpe_round_trip,
        op6_gam_quality,
        op7_chunked_media,
        op8_source_mixing,
        op9_language_id,
        op10_license_scan,
        op11_collocations,
        op12_periodic_runs,
        op13_suffix_dedup,
    )
}

ORACLES = {
    "op8_source_mixing": r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as hash
  from documents),
per as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (select *, row_number() over (order by source asc nulls last) - 1 as r from per),
weighed as (select *, cast([5, 2, 1][(r % 3) + 1] as bigint) as weight from ranked),
levels as (
  select *, (cast(sum(source_size) over () as double)
      - coalesce(cast(sum(3 * source_size) over (w rows between unbounded preceding and 1 preceding) as double), 0))
      / cast(sum(weight) over (w rows between current row and unbounded following) as double) as own_level,
         row_number() over (w) as place
  from weighed window w as (order by source_size * 1.0::double / weight, source asc nulls last)),
goal as (
  select source, source_size,
         least(weight * arg_min(own_level, place) filter (own_level * weight <= 3 * source_size) over (), cast(3 * source_size as double)) as target
  from levels),
rule as (select *, case when source_size > 0 then least(cast(floor(target / source_size) as bigint), 3) else 0 end as whole from goal),
upto as (
  select s.*, r.source_size, r.target, r.whole,
         sum(s.size) over (partition by s.source order by s.hash range between unbounded preceding and current row) as words,
         sum(s.size) over (partition by s.source, s.hash) as tied
  from sized s join rule r on s.source is not distinct from r.source)
select doc_id, size, source_size, target,
       cast(size * (whole + case when whole < 3 and (words <= target - whole * source_size
         or words - tied <= target - whole * source_size and tied < 2 * (target - whole * source_size - (words - tied))) then 1 else 0 end) as bigint) as taken
from upto""",
    "op11_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w
  from documents),
grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, (values (1), (2), (3), (4)) o(k))),
f as (select lang, k, phrase, count(*) as f from grams group by all),
words as (select lang, sum(len(w)) as n from pieces group by lang),
frequent as (select * from f where k >= 2 and f >= 30),
split as (select *, string_split(phrase, ' ') as w from frequent),
inside as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, f
  from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from split))),
longer as (select lang, phrase, max(f) as most from inside group by all),
cuts as (
  select s.lang, s.phrase, s.f as a, c, l.f as l, r.f as r, cast(2000000 as hugeint) * s.f // (cast(l.f as hugeint) + r.f) as score
  from (select *, unnest(range(1, k)) as c from split) s
  join f l on l.lang = s.lang and l.phrase = array_to_string(w[1:c], ' ')
  join f r on r.lang = s.lang and r.phrase = array_to_string(w[c + 1:], ' ')
  left join longer g on g.lang = s.lang and g.phrase = s.phrase
  where g.most is null or 100 * g.most < 80 * s.f),
lowest as (select lang, phrase, a, l, r, score from cuts qualify row_number() over (partition by lang, phrase order by score, c) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest)
select lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join words using (lang) where rank <= 2000""",
    "op13_suffix_dedup": r"""
with b as (select row_number() over () as rn, doc_id, encode(coalesce(text, '')) as t from documents),
part as (select rn, doc_id, octet_length(t) as n, hex(t) as h, unnest(range(0, octet_length(t), 256)) as base from b),
piece as (select rn, doc_id, n, base, substr(h, 2 * base + 1, 612) as h from part),
place as (select rn, doc_id, n, h, base, unnest(range(least(256, n - base))) as j from piece),
string as (select rn, doc_id, base + j as i, substr(h, 2 * j + 1, 2) as byte, case when base + j + 50 <= n then substr(h, 2 * j + 1, 100) end as s from place),
earliest as (select *, case when s is not null and min(doc_id) over (partition by s) < doc_id then i end as hit from string),
marked as (select *, coalesce(i - max(hit) over (partition by rn order by i) < 50, false) as gone from earliest),
turned as (select *, gone and not coalesce(lag(gone) over (partition by rn order by i), false) as begins from marked),
summed as (
  select rn, count(*) filter (gone) as n_removed, count(*) filter (begins) as n_spans, string_agg(byte, '' order by i) filter (not gone) as kept
  from turned group by rn)
select doc_id, cast(octet_length(t) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from b left join summed using (rn)""",
}
