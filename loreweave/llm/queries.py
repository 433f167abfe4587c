"""Queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, neardup, secretscan, sharding, topk, toolcalls, toxicity, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxic_documents(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.link(_table(spark, sf_dir, "documents"))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op5_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.normalise_pages(spark, _table(spark, sf_dir, "pages"))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link(*toolcalls.tool_events(_table(spark, sf_dir, "conversations")))


def op7_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(_table(spark, sf_dir, "documents"))


def _hex(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch date, told by their id."""
    return pages.select("page_id", "url", F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")).alias("fetched"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A list of three dated entries for each third host or parent domain among the pages: block, allow, block."""
    hosts = pages.select(urlfilter.host(F.col("url")).alias("domain")).where("domain <> ''").distinct()
    domains = hosts.unionByName(hosts.select(F.regexp_replace("domain", r"^[^.]*\.", "").alias("domain"))).distinct().where(_hex(F.col("domain")) % 3 == 0)
    each = domains.select("domain", F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("2"))).alias("i"))
    return each.select("domain", F.when(F.col("i") == "1", "allow").otherwise("block").alias("action"), F.date_add(F.to_date(F.lit("2024-01-01")), (_hex(F.concat("domain", "i")) % 365).cast("int")).alias("since"))


def op9_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    dates = {c: F.col(c).cast("string") for c in ("fetched", "valid_from", "valid_to")}
    return urlfilter.evaluate(captures(pages), dated_list(pages)).withColumns(dates)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", mixing.n_tokens(F.col("text")).alias("n_tokens"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_secret_links, op3_simhash_groups, op4_exact_topk, op5_warc_members, op6_tool_calls, op7_benchmark_matches, op8_shards, op9_url_list, op10_source_mix)}


_OP4 = """
with v as (select vec_id, min(embedding)::double[] as e from embeddings where vec_id is not null and embedding is not null group by vec_id),
s as (select a.vec_id as query_id, b.vec_id as vec_id, list_dot_product(a.e, b.e) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, round(score, 6) as score from r where rank <= 10"""

_OP6 = r"""
with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null and role in ('assistant', 'user')),
a as (select *, row_number() over w as n, lead(turn) over w as nxt, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as words
    from t where role = 'assistant' window w as (partition by conv_id order by turn, text)),
c as (select conv_id, turn, 'call_' || conv_id || '_' || turn as id, turn % 3 as kind, turn % 5 = 0 as gap, text, words,
    case when n % 2 = 1 and nxt is not null then 2 * n + 3 else 2 * n end as place from a),
r as (select conv_id, 'call_' || conv_id || '_' || (turn - 1) as id, text from t where role = 'user' and turn > 0),
j as (select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.id, r.id) as id, c.id is not null as called, r.id is not null as answered, place, gap,
    case when gap then '["missing ' || case kind when 0 then 'limit' when 1 then 'key' else 'words' end || '"]' else '[]' end as errors,
    case kind when 0 then '{' || case when gap then '' else '"limit":' || words || ',' end || '"query":' || to_json(c.text) || '}'
        when 1 then '{' || case when gap then '' else '"key":' || to_json(c.text) || ',' end || '"strict":true}'
        else '{"text":' || to_json(c.text) || case when gap then '' else ',"words":' || words end || '}' end as args,
    case kind when 0 then 'search' when 1 then 'lookup' else 'write' end as name, to_json(r.text)::varchar as content
    from c full join r on c.conv_id = r.conv_id and c.id = r.id)
select conv_id, count(*) filter (called)::int as n_calls, count(*) filter (called and answered)::int as n_linked, count(*) filter (called and gap)::int as n_invalid,
    count(*) filter (not called)::int as n_orphans,
    '{"calls":[' || coalesce(string_agg('{"arguments":' || args || ',"errors":' || errors || ',"id":"' || id || '","name":"' || name || '","result":' || coalesce(content, 'null') || '}', ',' order by place) filter (called), '')
    || '],"conversation":' || conv_id || ',"orphans":[' || coalesce(string_agg('{"content":' || content || ',"id":"' || id || '"}', ',' order by id) filter (not called), '') || ']}' as json
from j group by conv_id"""

_OP9 = r"""
with p as (select page_id, url, (date '2024-01-01' + ((page_id * 37) % 365)::int)::date as fetched,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', '') as host from pages),
d as (select distinct domain from (select host as domain from p where host <> '' union all select regexp_replace(host, '^[^.]*\.', '') from p where host <> '')
    where ('0x' || substr(md5(domain), 1, 8))::bigint % 3 = 0),
e as (select domain, case i when '1' then 'allow' else 'block' end as action, (date '2024-01-01' + (('0x' || substr(md5(domain || i), 1, 8))::bigint % 365)::int)::date as since
    from d, (values ('0'), ('1'), ('2')) as t(i)),
o as (select domain, since as valid_from, max(action) as action from e group by all),
v as (select *, lead(valid_from) over (partition by domain order by valid_from) as valid_to from o),
s as (select distinct host from p where strlen(host) <= 253),
n as (select host, unnest(range(1, len(string_split(host, '.')) + 1)) as i from s),
x as (select host, i, array_to_string(string_split(host, '.')[i:], '.') as domain from n),
h as (select p.page_id, x.i, v.domain, v.action, v.valid_from, v.valid_to, row_number() over (partition by p.page_id order by x.i) as k
    from p join x using (host) join v using (domain) where p.fetched >= v.valid_from and (v.valid_to is null or p.fetched < v.valid_to))
select p.page_id, p.url, p.fetched::varchar as fetched, p.host, coalesce(h.domain, '') as domain, coalesce(h.action, 'none') as action, h.valid_from::varchar as valid_from, h.valid_to::varchar as valid_to
from p left join h on h.page_id = p.page_id and h.k = 1"""


def oracle_sql() -> dict[str, str]:
    """None for the trained, approximate, seeded and byte-level ones: their tests use brute force, held-out accuracy or a round trip."""
    return {"op2_secret_links": secretscan.sql(), "op4_exact_topk": _OP4, "op6_tool_calls": _OP6, "op9_url_list": _OP9}
