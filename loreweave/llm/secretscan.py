"""Multipart credentials: access identifiers, secrets and endpoints linked within a scope.

A secret or an endpoint by itself is weak: it is reported only where a part of another kind lies
within ``scope`` characters in the same document. An access identifier names its kind by its prefix and
is reported always. Parts are intervals of characters; the join is by document and scope-sized bin, so
it stays near linear where one document holds very many parts. Values leave as digests only.

Defined results
* Null and empty texts: no parts. A null doc_id is a document of its own kind: its parts are linked
  only within the same text. Rows that repeat a doc_id with the same text count once, with another
  text apart.
* Each kind is found by a pass of its own: parts of one kind don't overlap (of several, the first from the
  left holds), parts of different kinds may, as a token in a URL does. Very long texts, and texts with very
  many parts: read whole; places are running sums, not sums for each part.
* Empty tables: no rows. Extra columns are ignored.

The patterns are common to Java, RE2 and Python: no look-around; what they can't tell is filtered afterwards.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import bound_batches, write_shared

SCOPE = 512
ID = r"\b(?:(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ABIA|ACCA)[0-9A-Z]{16}|AC[0-9a-f]{32}|pk_(?:live|test)_[0-9A-Za-z]{16,}|[0-9]{6,}-[0-9a-z]{32}\.apps\.googleusercontent\.com|[0-9a-z][0-9a-z\-]{2,63}@[0-9a-z\-]{3,64}\.iam\.gserviceaccount\.com)\b"
#: Names count in any case and with what is before and behind them, as in aws_secret_access_key; values are quoted
#: either way or bare, of 8 characters or more.
_SIGN = r"(?:\\?[\"'])?[ \t]{0,3}(?:=>|:=|==|[=:])[ \t]{0,3}"
NAMED = rf"(?i:passw(?:or)?d|passphrase|pwd|secret|token|(?:api|access|private|account|auth|encryption|signing)[_\-.]?key|credential)[0-9A-Za-z_.\-]{{0,40}}{_SIGN}(?:\\?\"[^\"\s\\]{{8,}}|\\?'[^'\s\\]{{8,}}|[^\s\"'<>&;,\\]{{8,}})"
MARKED = r"\b(?:(?:sk|rk)[_\-](?:live_|test_|proj-)?[0-9A-Za-z_\-]{16,}|gh[pousr]_[0-9A-Za-z]{36,}|github_pat_[0-9A-Za-z_]{22,}|glpat-[0-9A-Za-z_\-]{20,}|xox[abeoprs]-[0-9A-Za-z\-]{10,}|AIza[0-9A-Za-z_\-]{35}|eyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}|(?i:bearer)[ ]{1,3}[0-9A-Za-z+/_\-.=~]{16,})|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----|://[^\s/:@\"'<>]{0,128}:[^\s/@\"'<>]{1,256}@"
RUN = r"[0-9A-Za-z+/=]{40,}"
SECRET = f"{NAMED}|{MARKED}|{RUN}"
ENDPOINT = r"(?i:https?|wss?|s?ftps?|ssh|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?|s3|gs)://[^\s\"'<>\\]+|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"
#: A named value that is an identifier, or the name of one; hexadecimal digests; base64 keys.
NO_SECRET = rf"^[0-9A-Za-z_.\-]*(?:(?i:key[_\-.]?id){_SIGN}|{_SIGN}[\"']?(?:{ID}))"
HEX = r"^(?:[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"
KEY = r"^[0-9A-Za-z+/]{40}=*$"


@F.arrow_udf(T.BooleanType())
def _some(texts: pa.Array) -> pa.Array:
    """Whether a text has a part, by an automaton (RE2) that reads it once for each kind: far cheaper than backtracking."""
    out = None
    for pattern in (ID, SECRET, ENDPOINT):
        hit = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
        out = hit if out is None else pc.or_(out, hit)
    return out


def _secret(hit: Column) -> Column:
    told = hit.rlike(f"^(?:{NAMED})$") & ~hit.rlike(NO_SECRET) | hit.rlike(f"^(?:{MARKED})$")
    return told | hit.rlike(HEX) | hit.rlike(KEY) & hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")


def _intervals(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, doc_key, hit, start) of every match, from 0."""
    found = docs.where(F.col("text").rlike(pattern))
    both = found.select("doc_id", F.md5("text").alias("doc_key"), F.arrays_zip(F.transform(F.split("text", pattern, -1), lambda g: F.length(g)).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), 0).alias("hit")).alias("found"))
    each = both.select("doc_id", "doc_key", F.posexplode("found").alias("n", "x")).select("doc_id", "doc_key", "n", "x.gap", "x.hit").where("hit is not null")
    # one exchange serves both; the gaps up to a part, and the parts before it
    one = each.repartition("doc_id", "doc_key").dropDuplicates(["doc_id", "doc_key", "n"])
    so_far = Window.partitionBy("doc_id", "doc_key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return one.select("doc_id", "doc_key", "hit", (F.sum(F.col("gap") + F.length("hit")).over(so_far) - F.length("hit")).cast("int").alias("start"))


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, kind, start, stop, digest) of every part, from 0."""
    bound_batches(docs.sparkSession)
    some = write_shared(docs.select("doc_id", "text").where(_some("text")), "texts-with-parts")
    out = None
    for kind, pattern in (("id", ID), ("secret", SECRET), ("endpoint", ENDPOINT)):
        found = _intervals(some, pattern)
        found = found.where(_secret(F.col("hit"))) if kind == "secret" else found
        one = found.select("doc_id", "doc_key", F.lit(kind).alias("kind"), "start", (F.col("start") + F.length("hit")).alias("stop"), F.md5("hit").alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


def link(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, kind, start, stop, digest, n_ids, n_secrets, n_endpoints, strength): what is near each reported part, by kind."""
    p = write_shared(parts(docs), "parts")  # both sides of the join read it
    bins = lambda lo, hi: F.explode(F.sequence((lo / scope).cast("bigint"), (hi / scope).cast("bigint")))
    reach = p.withColumn("bin", bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("stop") + scope))
    other = p.select("doc_id", "doc_key", F.col("kind").alias("o_kind"), F.col("start").alias("o_start"), F.col("stop").alias("o_stop"), (F.col("start") / scope).cast("bigint").alias("bin"))
    on = reach["doc_id"].eqNullSafe(other["doc_id"]) & (reach["doc_key"] == other["doc_key"]) & (reach["bin"] == other["bin"]) & (reach["kind"] != other["o_kind"]) & (other["o_start"] <= reach["stop"] + scope) & (reach["start"] <= other["o_stop"] + scope)
    count = lambda k: F.count(F.when(F.col("o_kind") == k, 1)).alias(f"n_{k}s")
    near = reach.join(other, on, "left").groupBy(reach["doc_id"], reach["doc_key"], "kind", "start", "stop", "digest").agg(count("id"), count("secret"), count("endpoint"))
    several = F.col("n_ids") + F.col("n_secrets") + F.col("n_endpoints") > 0
    return near.where((F.col("kind") == "id") | several).select("doc_id", "kind", "start", "stop", "digest", "n_ids", "n_secrets", "n_endpoints", F.when(several, "linked").otherwise("alone").alias("strength"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_hits(kind: str, pattern: str) -> str:
    return f"""select doc_id, doc_key, '{kind}' as kind, hit, (sum(gap + length(hit)) over (partition by doc_id, doc_key order by n rows unbounded preceding) - length(hit))::bigint as start
    from (select doc_id, doc_key, unnest(range(len(hits))) as n, unnest(gaps[:len(hits)]) as gap, unnest(hits) as hit from (
        select doc_id, md5(text) as doc_key, list_transform(string_split_regex(text, {_q(pattern)}), lambda x: length(x)) as gaps, regexp_extract_all(text, {_q(pattern)}) as hits
        from (select distinct doc_id, text from documents where regexp_matches(text, {_q(pattern)}))))"""


def sql(scope: int = SCOPE) -> str:
    """The same in DuckDB."""
    return f"""
with hits as ({" union all ".join(_sql_hits(k, p) for k, p in (("id", ID), ("secret", SECRET), ("endpoint", ENDPOINT)))}),
p as (select doc_id, doc_key, kind, start, start + length(hit) as stop, md5(hit) as digest from hits where kind <> 'secret'
    or regexp_matches(hit, {_q(f"^(?:{NAMED})$")}) and not regexp_matches(hit, {_q(NO_SECRET)}) or regexp_matches(hit, {_q(f"^(?:{MARKED})$")})
    or regexp_matches(hit, {_q(HEX)}) or regexp_matches(hit, {_q(KEY)}) and regexp_matches(hit, '[0-9]') and regexp_matches(hit, '[a-z]') and regexp_matches(hit, '[A-Z]')),
near as (select a.doc_id, a.doc_key, a.kind, a.start, a.stop, a.digest, count(case when b.kind = 'id' then 1 end) as n_ids, count(case when b.kind = 'secret' then 1 end) as n_secrets, count(case when b.kind = 'endpoint' then 1 end) as n_endpoints
    from p a left join p b on a.doc_id is not distinct from b.doc_id and a.doc_key = b.doc_key and a.kind <> b.kind and b.start <= a.stop + {scope} and a.start <= b.stop + {scope} group by all)
select doc_id, kind, start::int as start, stop::int as stop, digest, n_ids, n_secrets, n_endpoints, case when n_ids + n_secrets + n_endpoints > 0 then 'linked' else 'alone' end as strength
from near where kind = 'id' or n_ids + n_secrets + n_endpoints > 0"""
