"""Not-modified revisits of web archives, resolved to the full responses they stand for.

Method: an as-of join by canonical URL. Every revisit takes the latest earlier full response of its
URL; the first of its validators (ETag, Last-Modified, payload digest) that the response has too must
agree with the response's, and those of its headers that a 304 answer may update replace the response's.

Scale: captures carry ids, validators and headers only, never bodies. Time is cut into slices of
about SLICE_ROWS captures; a window runs within one URL and slice, so a URL that a third of all
captures share is spread over all slices. What a slice starts with is the last response of the
slices before it: one row a URL and slice, joined back to revisits that found none in their own.

Cases: a null URL or time matches nothing and stays unresolved; of responses at one time the one with
the greatest id counts, one at the revisit's own time does not; a revisit that shares no validator with
the response is ``unchecked``; repeated rows each get their result; empty tables give none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.llm.shared import stage

SLICE_ROWS = 100_000
#: Headers that a not-modified answer updates (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)="

CAPTURE = ("id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers")


def canonical_url(url: Column) -> Column:
    """Host without scheme, ``www.`` and default port, lower-cased; path without a last slash; sorted
    query without tracking parameters; no fragment. Null for what has no scheme and host."""
    plain = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]+)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^:/?]+://[^/?]+([^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(plain, r"[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    whole = F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))
    return F.when(host != "", whole)


def _plain_tag(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(tag, "^W/", "")


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers with the permitted ones of the revisit; names lower-cased, the last of equals."""
    low = lambda m: F.transform(F.map_entries(F.coalesce(m, F.expr("cast(map() as map<string,string>)"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    own = F.filter(low(revisit), lambda e: e["key"].isin(*PERMITTED))
    kept = F.filter(low(response), lambda e: ~F.exists(own, lambda o: o["key"] == e["key"]))
    whole = F.concat(kept, own)
    names = F.array_sort(F.array_distinct(F.transform(whole, lambda e: e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(whole, lambda e: e["key"] == n), -1)["value"]))


def resolve(captures: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row for each revisit of ``captures`` (columns CAPTURE; kind ``response`` or ``revisit``).

    id, canonical_url, ts, target_id, target_digest, status (resolved, unchecked, mismatch,
    unresolved) and headers: the response's merged with the revisit's where it is resolved.
    """
    own = stage(captures.select("id", canonical_url(F.col("url")).alias("key"), "ts", "kind", "etag", "last_modified", "digest", F.to_json("headers").alias("headers")).where(F.col("kind").isin("response", "revisit")), "captures")
    low, high, n = own.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    usable = F.col("key").isNotNull() & F.col("ts").isNotNull()
    slices = max(1, -(-n // slice_rows))
    span = (high - low + 1) if n and high is not None else 1
    timed = own.where(usable).withColumn("slice", F.floor((F.col("ts") - F.lit(low if low is not None else 0)) * F.lit(slices) / F.lit(span)).cast("long"))
    response = F.when(F.col("kind") == "response", F.struct("ts", "id", "etag", "last_modified", "digest", "headers"))
    # At one time revisits come before responses, which are thus not earlier.
    within = Window.partitionBy("key", "slice").orderBy("ts", F.col("kind").desc(), "id").rowsBetween(Window.unboundedPreceding, 0)
    seen = timed.withColumn("near", F.last(response, ignorenulls=True).over(within)).where("kind = 'revisit'")
    last = timed.where("kind = 'response'").groupBy("key", "slice").agg(F.max(F.struct("ts", "id", "etag", "last_modified", "digest", "headers")).alias("last"))
    held = timed.select("key", "slice").distinct().join(last, ["key", "slice"], "left")
    before = held.withColumn("far", F.last("last", ignorenulls=True).over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select("key", "slice", "far").where("far is not null")
    found = seen.join(before, ["key", "slice"], "left").withColumn("hit", F.coalesce("near", "far")).drop("near", "far", "slice")
    lost = own.where(~usable & (F.col("kind") == "revisit")).withColumn("hit", F.lit(None).cast(found.schema["hit"].dataType))
    every = found.unionByName(lost)
    both_have = lambda c: F.col(c).isNotNull() & F.col(f"hit.{c}").isNotNull()
    agree = (
        F.when(both_have("etag"), _plain_tag(F.col("etag")) == _plain_tag(F.col("hit.etag")))
        .when(both_have("last_modified"), F.col("last_modified") == F.col("hit.last_modified"))
        .when(both_have("digest"), F.col("digest") == F.col("hit.digest"))
    )
    status = F.when(F.col("hit").isNull(), "unresolved").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("mismatch")
    parse = lambda c: F.from_json(c, "map<string,string>")
    judged = every.withColumn("status", status)
    return judged.select(
        "id",
        F.col("key").alias("canonical_url"),
        "ts",
        F.col("hit.id").alias("target_id"),
        F.col("hit.digest").alias("target_digest"),
        "status",
        F.when(F.col("status").isin("resolved", "unchecked"), merged_headers(parse(F.col("hit.headers")), parse(F.col("headers")))).alias("headers"),
    )


#: How much later, in capture ticks, a page's revisit comes than its response.
REVISIT_AFTER = 20_001


def page_captures(pages: DataFrame) -> DataFrame:
    """Two captures of each page: its full response at 2 * page_id, and a not-modified revisit later,
    by another spelling of the URL. A page without html has no full response."""
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    page = F.col("page_id").cast("long")
    full = pages.where("html is not null").select(page.alias("id"), "url", (2 * page).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.md5("html").alias("digest"),
                                                  F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("ETag"), tag, F.lit("Date"), page.cast("string")).alias("headers"))
    again = pages.select(page.alias("id"), F.concat("url", F.lit("#again")).alias("url"), (2 * page + REVISIT_AFTER).alias("ts"), F.lit("revisit").alias("kind"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
                         F.create_map(F.lit("Date"), (page + REVISIT_AFTER).cast("string"), F.lit("Content-Length"), F.lit("0"), F.lit("Expires"), F.lit("never")).alias("headers"))
    return full.unionByName(again)


def digest(found: DataFrame) -> DataFrame:
    """``resolve`` with headers as one sorted string."""
    lines = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.select(F.col("id").alias("page_id"), "canonical_url", "target_id", "target_digest", "status", F.coalesce(lines, F.lit("")).alias("headers"))


ORACLE = r"""
with own as (
  select page_id, html, regexp_replace(url, '#.*$', '') as plain from pages
), parts as (
  select page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]+)', 1)), '^www\.', ''), ':(80|443)$', '') as host,
    regexp_replace(regexp_extract(plain, '^[^:/?]+://[^/?]+([^?]*)', 1), '/+$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(plain, '[?](.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)='))) as params
  from own
), keyed as (
  select page_id, html, case when host <> '' then host || path || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end end as k from parts
), hits as (
  select r.page_id, r.k, r.html, f.page_id as target, f.html as full_html,
    row_number() over (partition by r.page_id order by f.page_id desc) as rn
  from keyed r left join keyed f on f.k = r.k and f.html is not null and 2 * f.page_id < 2 * r.page_id + 20001
)
select page_id, k as canonical_url, target as target_id, md5(full_html) as target_digest,
  case when target is null then 'unresolved' when html is null then 'unchecked' when md5(html) = md5(full_html) then 'resolved' else 'mismatch' end as status,
  case when target is not null and (html is null or md5(html) = md5(full_html)) then
    'content-length: ' || strlen(full_html) || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || (page_id + 20001) || chr(10) || 'etag: "' || md5(full_html) || '"' || chr(10) || 'expires: never' else '' end as headers
from hits where rn = 1
"""
