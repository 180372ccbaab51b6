"""The corpus operators as registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from .common import table
from .exact_dedup import exact_dedup
from .fingerprints import fingerprint_documents
from .html_text import extract_pages
from .mixing import mix_sources
from .near_dedup import near_dedup
from .packing import pack
from .pii import find_personal_data
from .suffix_dedup import suffix_dedup
from .token_counts import count_tokens
from .toxicity import toxicity


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("source_sha256")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("text_key")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is the folder that the session names in ``spark.emberrule.tokenCache``, a new one where that is unset."""
    cache = spark.conf.get("spark.emberrule.tokenCache", None)
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache or None)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op6_toxicity": op6_toxicity,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_fingerprints": op8_fingerprints,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_mix_sources": op10_mix_sources,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
with n as (
  select doc_id, length(coalesce(text, '')) as points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
r as (
  select *, first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id) as keep_id,
         count(*) over (partition by text_sha256) as group_size
  from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from r
""",
    "op10_mix_sources": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         (('0x' || substr(md5('mix:' || doc_id::varchar), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as unit
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         ((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint as weight
  from d group by source),
c as (
  select *, 3 * source_size as cap, sum(source_size) over () as total,
         sum(3 * source_size) over o as cap_upto, sum(weight) over () - sum(weight) over o as weight_after,
         3 * source_size / weight::double as ratio
  from s window o as (order by 3 * source_size / weight::double, source rows unbounded preceding)),
f as (
  select total / (select sum(weight) from s)::double as level from c
  qualify row_number() over (order by ratio, source) = 1 and level <= ratio
  union all
  select (total - cap_upto) / weight_after::double as level from c
  qualify weight_after > 0 and level > ratio and level <= lead(ratio) over (order by ratio, source)
  limit 1),
t as (
  select source, source_size, least(weight * level, cap::double) as target,
         case when source_size > 0 then floor(least(weight * level, cap::double) / source_size)::bigint else 0 end as whole
  from c, f),
z as (
  select d.source, size, target - whole * source_size as rest, sum(size) as words, sqrt(size::double) as root
  from d join t on d.source is not distinct from t.source where size > 0 group by all),
l as (
  select source, max_by(level, size) as level
  from (select source, size, root, (rest - coalesce(sum(words) over (o rows between unbounded preceding and 1 preceding), 0))
               / sum(words * root) over (o rows between current row and unbounded following) as level
        from z where rest > 0 window o as (partition by source order by size desc))
  where level * root < 1 group by source),
r as (
  select d.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size as rest,
         case when level * sqrt(size::double) >= 1 then 0
              when size > 0 then (unit / (1 - unit)) / ((level * sqrt(size::double)) / (1 - level * sqrt(size::double))) end as rank
  from d join t on d.source is not distinct from t.source left join l on d.source is not distinct from l.source),
u as (select *, sum(size) over (partition by source order by rank nulls last, doc_id rows unbounded preceding) as upto from r),
g as (
  select *, rest > 0 and size > 0 and upto <= rest as front,
         rest - coalesce(max(case when upto <= rest then upto end) over (partition by source), 0) as gap
  from u),
x as (
  select *, row_number() over (partition by source order by
    case when not front and rest > 0 and size > 0 and abs(gap - size) < gap then abs(gap - size) end nulls last, rank, doc_id) as nth
  from g)
select doc_id, size, source_size, target,
       size * (whole + case when front or (nth = 1 and not front and rest > 0 and size > 0 and abs(gap - size) < gap) then 1 else 0 end)::bigint as taken
from x
""",
}
