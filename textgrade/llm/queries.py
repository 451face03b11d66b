"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textgrade.llm.common import table
from textgrade.llm.curves import nearest_neighbours
from textgrade.llm.extraction import extract_main_text
from textgrade.llm.imatch import fingerprint_documents
from textgrade.llm.language import identify_language
from textgrade.llm.ledger import new_ledger, scan_secrets, span_digest
from textgrade.llm.merkle import merkle_manifest, merkle_sql, without_line_breaks
from textgrade.llm.minmax import near_duplicates
from textgrade.llm.mixing import MIX_SQL, mix_sources
from textgrade.llm.packing import pack_documents
from textgrade.llm.periodic import periodic_runs
from textgrade.llm.tokens import section_tokens
from textgrade.llm.topk import TOP_SQL, top_products
from textgrade.llm.warc import archive_digest, new_archive, read_archive, write_archive


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on web pages, which have real addresses and declare their language in the markup."""
    pages = table(spark, sf_dir, "pages")
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    texts = extract_main_text(pages.withColumn("declared", declared), ("page_id", "url", "declared"))
    found = identify_language(texts, "page_id", "text", "declared", "url")
    return found.withColumnRenamed("doc_id", "page_id")


def op2_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op3_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_archive(spark)
    write_archive(table(spark, sf_dir, "pages"), path)
    return archive_digest(read_archive(spark, path))


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two states of one collection: an earlier one with about half of the documents, then all of them
    docs, ledger = table(spark, sf_dir, "documents"), new_ledger(spark)
    scan_secrets(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), ledger=ledger)
    return span_digest(scan_secrets(docs, ledger=ledger))


def op7_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


def op8_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = merkle_manifest(table(spark, sf_dir, "documents"), changed=without_line_breaks())
    return manifest.drop("proof")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True).drop("runs", "collapsed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_language_id,
        pages_language_id,
        op2_minmax_near_duplicates,
        op3_section_tokens,
        op4_main_text,
        op5_warc_archive,
        op6_secret_ledger,
        op7_top_products,
        op8_curve_neighbours,
        op9_pareto_mix,
        op10_vector_packing,
        op11_imatch_fingerprints,
        op12_merkle_manifest,
        op13_periodic_runs,
    )
}

WARC_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
f as (select html, min(page_id) as first from p group by html)
select p.page_id, octet_length(encode(p.html))::bigint as payload_bytes,
  upper(translate(array_to_string([
    substr('abcdefghijklmnopqrstuvwxyz234567', (('0x' || substr(sha1(p.html), 1 + 5 * (k // 4), 5))::bigint // [32768, 1024, 32, 1][(k % 4 + 1)::int] % 32 + 1)::int, 1)
    for k in range(32)], ''), '', '')) as payload_digest,
  case when p.page_id = f.first then 'response' else 'revisit' end as record_type,
  case when p.page_id = f.first then null else f.first end as refers_to
from p join f on p.html = f.html
"""

# Failing matches still take their characters from later ones, so the matches are listed before they are judged.
SECRET_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
kinds as (
  select * from (values
    (0, 'assign', '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+',
      '(?i)^(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?', 12),
    (1, 'access', 'AKIA[A-Z0-9]+', '^', 18),
    (2, 'hex', '[0-9a-f]{16,}', '^', 16)) k(kind, name, pattern, head, least)
), m as (
  select doc_id, kind, name, head, least, regexp_extract_all(text, pattern) as hits, string_split_regex(text, pattern) as gaps
  from d, kinds where regexp_matches(text, pattern)
), e as (
  select doc_id, kind, name, head, least, i, hits[i] as hit, gaps[i] as gap
  from (select *, unnest(range(1, len(hits) + 1)) as i from m)
), s as (
  select *, sum(length(hit) + length(gap)) over (partition by doc_id, kind order by i) as stop from e
), g as (
  select doc_id, name, kind, stop - length(hit) as start, stop from s
  where length(regexp_replace(hit, head, '')) >= least
), a as (
  select doc_id, count(*) filter (where name = 'assign') as n_assign, count(*) filter (where name = 'access') as n_access,
    count(*) filter (where name = 'hex') as n_hex,
    string_agg(name || ':' || start::bigint || ':' || stop::bigint, ',' order by start, kind) as spans
  from g group by doc_id
)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
  coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (doc_id)
"""

ORACLES: dict[str, str] = {
    "op5_warc_archive": WARC_SQL,
    "op6_secret_ledger": SECRET_SQL,
    "op7_top_products": TOP_SQL,
    "op9_pareto_mix": MIX_SQL.format(docs="documents"),
    "op12_merkle_manifest": merkle_sql(),
}
