"""The operators of this subpackage as queries over the provided tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import (
    arc, embedding_dedup, filter_audit, fingerprints, host_reputation, html_blocks, lexical_search, mixing, packing, quality, simhash_dedup, token_trees,
    toxicity,
)
from codeloom.llm.common import Scratch, join_unique, remove, table
from codeloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@query
def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, repeated so that every source has the same share of the text."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


ORACLES["op1_poisson_mix"] = """
with recursive sizes as materialized (
  select source, sum(coalesce(length(text), 0))::bigint as size from documents group by source),
total as (select sum(size)::double as total, count(*) as number from sizes),
rates as materialized (
  select source, coalesce(case when size <> 0 then (1.0::double / number) * total / size::double end, 1.0::double) as rate
  from sizes, total),
parts as (select source, rate, greatest(ceil(rate / 16), 1)::int as parts from rates),
steps(source, parts, mean, k, p, below) as (
  select source, parts, rate / parts, 0, exp(-(rate / parts)), exp(-(rate / parts)) from parts
  union all
  select source, parts, mean, k + 1, p * mean / (k + 1), below + p * mean / (k + 1) from steps
  where k < least(120, ceil(mean * 4 + 30))),
marks as (
  select doc_id, rowid_, source, part,
    ('0x' || substr(md5('17:count:' || coalesce(doc_id::varchar, '') || ':' || part), 1, 13))::bigint::double / 4503599627370496.0::double as unit
  from (select doc_id, source, row_number() over () as rowid_ from documents) d
  join parts using (source), range(1, parts + 1) r(part)),
counts as (
  select rowid_, doc_id, count(*) filter (where below <= unit)::int as n from marks m join steps s on m.source = s.source
  group by rowid_, doc_id),
per_id as (select doc_id, max(n) as n from counts group by doc_id)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::int as copy, p.n as n_copies, r.rate,
  ('0x' || substr(md5('17:order:' || coalesce(d.doc_id::varchar, '') || ':' || c.copy), 1, 13))::bigint::double / 4503599627370496.0::double as mix_key
from documents d join rates r using (source) join per_id p using (doc_id), range(1, p.n + 1) c(copy)
"""


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents, fingerprints at most four bits apart."""
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))


@query
def op9_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, their likeness, and how many documents lie near each."""
    scratch = Scratch(spark, "fingerprints")
    prints = scratch.keep(fingerprints.fingerprint_documents(table(spark, sf_dir, "documents")))
    near = scratch.keep(fingerprints.within_radius(prints))
    digits = lambda name: F.lpad(F.lower(F.hex(name)), 16, "0")
    alike = lambda a, b: 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64
    return join_unique(prints, near, "fp", "n_docs").select(
        "doc_id", "n_chars", "edited_sha256", digits("fp").alias("fingerprint"), digits("edited_fp").alias("edited_fingerprint"),
        alike("fp", "edited_fp").alias("near_edited"), alike("fp", "next_fp").alias("near_next"), "n_within")


@query
def op7_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a network trained on labelled ones outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


# (verdict, host, path) of the rules that come before the reputation.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@query
def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all urls; an outcome is bad if the page is labelled toxic or of low quality."""
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return host_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


ORACLES["op3_host_reputation"] = """
with places as materialized (
  select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages)),
outcomes as (select doc_id as page_id, (quality = 0 or toxic = 1) as bad from labels where doc_id is not null and (quality = 0 or toxic = 1) is not null),
counted as (select host, count(bad) as n, count(*) filter (where bad) as x from places left join outcomes using (page_id) group by host),
names as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?\\.?$', '') as name from counted),
labelled as (select *, string_split(name, '.') as labels, regexp_matches(name, '^[0-9.]+$') as number from names),
two as (select *, array_to_string(labels[-2:], '.') in ('ac.uk', 'co.uk', 'gov.uk', 'org.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.za', 'com.br', 'com.cn',
  'co.in', 'co.jp', 'ne.jp', 'or.jp', 'co.kr', 'com.mx', 'com.tr', 'com.tw', 'com.ar') as two from labelled),
hosts as materialized (
  select host, n, x, case when number then name when two then array_to_string(labels[-3:], '.') else array_to_string(labels[-2:], '.') end as domain,
    case when number then name when two then array_to_string(labels[-2:], '.') else labels[-1] end as suffix from two),
overall as (select (sum(x) + 0.5::double) / (sum(n) + 1.0::double) as m from hosts),
suffixes as materialized (select suffix, sum(n)::bigint as n, sum(x)::bigint as x, any_value(m) as m from hosts, overall group by suffix),
strength_s as (select 1 / least(greatest(coalesce((sum((x - n * m) * (x - n * m)) - sum(n * m * (1 - m))) / nullif(sum((n - 1) * (n * m * (1 - m))), 0), 0.0001), 0.0001::double), 0.5::double) - 1 as s from suffixes),
suffix_means as (select suffix, (s * m + x) / (s + n) as m from suffixes, strength_s),
domains as materialized (
  select domain, sum(n)::bigint as n, sum(x)::bigint as x, any_value(m) as m from hosts join suffix_means using (suffix) group by domain),
strength_d as (select 1 / least(greatest(coalesce((sum((x - n * m) * (x - n * m)) - sum(n * m * (1 - m))) / nullif(sum((n - 1) * (n * m * (1 - m))), 0), 0.0001), 0.0001::double), 0.5::double) - 1 as s from domains),
domain_means as (select domain, (s * m + x) / (s + n) as m from domains, strength_d),
priors as materialized (select host, n, x, m from hosts join domain_means using (domain)),
strength_h as (select 1 / least(greatest(coalesce((sum((x - n * m) * (x - n * m)) - sum(n * m * (1 - m))) / nullif(sum((n - 1) * (n * m * (1 - m))), 0), 0.0001), 0.0001::double), 0.5::double) - 1 as s from priors),
means as (select host, n, s, (s * m + x) / (s + n) as mean from priors, strength_h),
reputation as (select host, n, mean, mean - 1.645::double * sqrt(mean * (1 - mean) / (s + n + 1)) as low from means),
rules(name, verdict, host, path) as (values ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
fitting as (
  select p.host, p.path, arg_max(struct_pack(name := r.name, verdict := r.verdict), length(r.name) * 1000 + length(r.host)) as best
  from (select distinct host, path from places) p join rules r
    on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
  group by p.host, p.path)
select page_id, host, path, best.name as rule, coalesce(best.verdict, case when low > 0.2 then 'block' else 'allow' end) as verdict,
  n as n_labelled, round(mean, 6) as bad_mean, round(low, 6) as bad_low
from places join reputation using (host) left join fitting using (host, path)
"""


@query
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_blocks.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as legacy archives, converted to WARC and read back."""
    legacy, converted = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    arc.write_arc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), legacy)
    arc.convert(spark, legacy, converted, min_bytes=0, whole_only=True)
    remove(spark, legacy)
    scratch = Scratch(spark, "warc-records")
    records = scratch.keep(arc.read_warc(spark, converted, with_payload=False).drop("payload"))
    remove(spark, converted)
    return arc.resolved(records).drop("target_uri")


ORACLES["op6_arc_to_warc"] = """
with payloads as (select page_id, coalesce(html, '') as html from pages),
digests as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha1(html) as hex from payloads),
named as (
  select page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, 1 + 5 * i::int, 5))::int >> 15), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * i::int, 5))::int >> 10) & 31), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * i::int, 5))::int >> 5) & 31), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, 1 + 5 * i::int, 5))::int & 31), 1)), '') as payload_digest
  from digests),
firsts as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as first from named)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from firsts
"""


@query
def op2_pivot_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with a cosine of at least 0.9."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op2_pivot_near_duplicates"] = """
with recursive units as materialized (
  select vec_id, list_transform(embedding::double[], lambda x: x / sqrt(list_inner_product(embedding::double[], embedding::double[]))) as u
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (
  select a.vec_id as a, b.vec_id as b from units a join units b on a.vec_id <> b.vec_id and list_inner_product(a.u, b.u) >= 0.9),
reached(a, b) as (select vec_id, vec_id from units union select r.a, l.b from reached r join links l on r.b = l.a),
least as (select a, min(b) as component_id from reached group by a),
degree as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, coalesce(l.component_id, e.vec_id) as component_id, e.vec_id = coalesce(l.component_id, e.vec_id) as kept
from embeddings e left join degree d on d.a = e.vec_id left join least l on l.a = e.vec_id
"""


@query
def op8_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after four edits each: at a quarter, in the middle, at three quarters, at the end."""
    scratch = Scratch(spark, "trees")
    trees = scratch.keep(token_trees.build_trees(table(spark, sf_dir, "documents")))
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    edit = lambda start, length, text: F.struct(start.alias("start"), length.cast("long").alias("length"), text.alias("text"))
    inserted = F.substring("text", 1, 40)
    edits = F.array(
        edit(F.floor(n / 4), F.lit(25), F.concat(F.lit(" changed at "), F.col("doc_id").cast("string"))),
        edit(F.floor(n / 2), F.lit(0), inserted),
        edit(F.floor(n * 3 / 4), F.least(F.floor(n / 8), F.lit(300)), F.lit("")),
        edit(n, F.lit(0), F.lit("\n\nEnd.  ")))
    edited = token_trees.apply_edits(trees.withColumn("edits", edits))
    return edited.select("doc_id", "n_tokens_before", "n_tokens", F.char_length("text").cast("long").alias("n_chars"), "encoded_chars",
                         F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from the documents of every language, in all orders."""
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = """
with recursive texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
marks as (
  select doc_id, part,
    (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
    + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as mask
  from texts),
flags as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
counts as materialized (
  select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from marks left join flags using (doc_id) group by part, mask),
letters(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
chains(filter_order, used) as (
  select '', 0 union all select filter_order || letter, used + bit from chains, letters where used & bit = 0),
steps as (
  select filter_order, step, bit, (select coalesce(sum(l.bit), 0) from letters l where position(l.letter in filter_order) < step)::int as before
  from (select filter_order from chains where used = 31), range(1, 6) r(step), letters where letter = filter_order[step]),
audit as (
  select part, filter_order, step::int as step, bit,
    coalesce(sum(n) filter (where mask & (before + bit) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (where mask & before = 0 and mask & bit <> 0), 0)::bigint as removed,
    coalesce(sum(n) filter (where mask & before <> 0 and mask & bit <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (where mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (where mask & before = 0 and mask & bit <> 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (where mask & before = 0 and mask & bit <> 0), 0)::bigint as toxic_lost
  from counts, steps group by part, filter_order, step, bit)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, bit))::bigint as shapley
from audit
"""


@query
def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical_search.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_dual_tree_search"] = """
with found as (
  select doc_id, row_number() over () as row_, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from documents where text is not null),
docs as materialized (select doc_id, row_, terms, len(terms)::bigint as n from found where len(terms) > 0),
sizes as (select count(*)::bigint as docs, sum(n)::bigint as total from docs),
asked as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from benchmark),
wanted as materialized (select item_id, term, count(*)::bigint as times from asked group by item_id, term),
held as materialized (
  select doc_id, row_, n, term, count(*)::bigint as tf
  from (select doc_id, row_, n, unnest(terms) as term from docs) where term in (select term from wanted) group by all),
weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*)::bigint as df from held group by term), sizes),
scores as (
  select item_id, row_, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))))::bigint as score
  from wanted join weights using (term) join held using (term), sizes group by item_id, row_, doc_id),
ranked as (
  select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scores where score > 0)
select * from ranked where rank <= 20
"""


@query
def op11_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by attention over its passages, learnt from labelled ones outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))
