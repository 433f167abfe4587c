"""Temporal URL list: dated entries become validity intervals, and captures meet those active at fetch time.

An entry (domain, action, since) holds until the domain's next one. A capture is matched by its host
and every parent domain; the most specific domain with an active entry decides. The as-of join is an
equi-join by domain and a range on dates, so it shuffles by domain where the list is too large for
the size-checked broadcast that Spark chooses, and adaptive execution splits hot domains.

Defined results
* Null or unparsable urls and null fetch times: no entry applies; action "none".
* Entries with a null domain, action or date are ignored. Of entries of one domain and date, the
  greatest action in alphabetical order holds ("block" after "allow"). Repeated entries change nothing.
* Every capture row comes out once for each time it went in, repeated ids included.
* Empty list: all "none". Empty captures: no rows. Extra columns are ignored.
* A host of more than 253 bytes can't be a domain name: no entry applies, action "none". So a host has 127 parents at
  most, however long the url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_HOST = 253
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host(url: Column) -> Column:
    """The url's host in lower case, without user, port or final dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, valid_from, valid_to) from dated entries; valid_to is null for the last of each domain."""
    one = entries.select(F.lower("domain").alias("domain"), "action", F.col("since").alias("valid_from")).where("domain is not null and action is not null and valid_from is not null").groupBy("domain", "valid_from").agg(F.max("action").alias("action"))
    return one.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("domain").orderBy("valid_from"))).select("domain", "action", "valid_from", "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched, host, domain, action, valid_from, valid_to) of each capture (page_id, url, fetched)."""
    base = captures.select("page_id", "url", "fetched").withColumn("host", F.coalesce(host(F.col("url")), F.lit("")))
    labels = F.split("host", r"\.")
    depth = F.size(labels)
    keyed = base.withColumn("capture", F.struct("page_id", "url", "fetched"))
    # rows alike are decided alike: decide each once, with its number
    each = keyed.groupBy("page_id", "url", "fetched", "host").agg(F.count("*").alias("copies"))
    at = each.where(F.octet_length("host") <= MOST_HOST).select("*", F.posexplode(F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(labels, i, depth), "."))).alias("parents", "domain"))
    active = intervals(entries)
    hit = at.join(active, ["domain"]).where("fetched >= valid_from and (valid_to is null or fetched < valid_to)")
    best = hit.groupBy("page_id", "url", "fetched", "host", "copies").agg(F.min_by(F.struct("domain", "action", "valid_from", "valid_to"), "parents").alias("best"))
    key = [F.col(f"e.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("page_id", "url", "fetched", "host")]
    on = key[0] & key[1] & key[2] & key[3]
    out = each.alias("e").join(best.alias("b"), on, "left").select("e.page_id", "e.url", "e.fetched", "e.host", F.coalesce("b.best.domain", F.lit("")).alias("domain"), F.coalesce("b.best.action", F.lit("none")).alias("action"), "b.best.valid_from", "b.best.valid_to", F.explode(F.sequence(F.lit(1), F.col("e.copies").cast("int"))).alias("copy"))
    return out.drop("copy")
