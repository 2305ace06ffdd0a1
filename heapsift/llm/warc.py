"""WARC not-modified revisits: an as-of join by canonical URL to the latest earlier full response, validators checked, headers merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

#: Query parameters that do not tell pages apart.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"
#: Header fields of a not-modified answer that replace those of the stored response. Others, such as Content-Length, stay as they were.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Seconds of a time block. Captures of one URL meet a task by block, so that a URL with very many is split.
BLOCK = 86_400


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without scheme, user, default port, fragment, tracking parameters, empty query and final slash of an empty path; other parameters sorted. Null stays null."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r":(?:80|443)?$", "")
    path = F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^{TRACKING}(?:=|$)")))
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def weak(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def resolve_revisits(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each not-modified revisit of records: its columns and status, response_id, merged_headers.

    records: record_id (unique), url, ts (seconds, long), kind ('response' or 'revisit'), http_status (int), headers (map of lower-case names). A full response is
    of kind response with status 200. status is 'resolved', 'validator_mismatch' (the latest earlier full response has another ETag or, where
    either lacks one, another Last-Modified), 'no_validator' (no validator that both have) or 'no_earlier'. ETags are compared weakly. Of
    responses of one second the one of the larger record_id is the later; one of the revisit's own second is not earlier. merged_headers are
    the response's with the PERMITTED fields of the revisit put over them; null unless resolved. A null url, ts or record_id makes a revisit
    'no_earlier', and such a response is never found. Other columns of revisits come along, also if named as one of the new ones, which then
    replace them. Bodies are not touched: they are found by response_id.

    A revisit is looked up in its own time block by a window over URL and block. For earlier blocks, the latest response of each is one
    row, and a window over these finds the latest before; so no task holds all captures of a URL.
    """
    # Every join is on tables of this function's own names; the rows themselves come back last, by their id.
    headers = F.col("headers")
    base = records.select(canonical_url(F.col("url")).alias("key"), F.floor(F.col("ts") / block).alias("block"), "ts", "record_id", "kind", "http_status", headers.alias("headers"))
    usable = F.col("key").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    full = base.where(usable & (F.col("kind") == "response") & (F.col("http_status") == 200))
    again = (F.col("kind") == "revisit") & (F.col("http_status") == 304)
    points = full.select("key", "block", "ts", "record_id", F.lit(True).alias("full")).union(base.where(again & usable).select("key", "block", "ts", "record_id", F.lit(False)))
    moment = F.struct("ts", "record_id")
    inside = Window.partitionBy("key", "block").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    seen = points.withColumn("near", F.max(F.when(F.col("full"), moment)).over(inside)).where(~F.col("full"))
    ends = full.groupBy("key", "block").agg(F.max(moment).alias("last")).select("key", "block", "last")
    asked = seen.where("near is null").select("key", "block").distinct().withColumn("last", F.lit(None).cast(ends.schema["last"].dataType))
    before = Window.partitionBy("key").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    earlier = ends.union(asked).withColumn("far", F.max("last").over(before)).where("far is not null").groupBy("key", "block").agg(F.max("far").alias("far"))
    rid, response, stored = fresh(records, "id", "response", "stored")
    found = seen.join(earlier, ["key", "block"], "left").select(F.col("record_id").alias(rid), F.coalesce("near", "far")["record_id"].alias(response)).where(F.col(response).isNotNull())
    found = found.join(full.select(F.col("record_id").alias(response), F.col("headers").alias(stored)), response)
    out = records.where(again).join(found, F.col("record_id") == F.col(rid), "left")
    old = lambda name: F.col(stored)[name]
    new = lambda name: headers[name]
    both = lambda name: old(name).isNotNull() & new(name).isNotNull()
    status = F.when(F.col(response).isNull(), "no_earlier").when(both("etag"), F.when(weak(old("etag")) == weak(new("etag")), "resolved").otherwise("validator_mismatch"))
    status = status.when(both("last-modified"), F.when(old("last-modified") == new("last-modified"), "resolved").otherwise("validator_mismatch")).otherwise("no_validator")
    over = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.coalesce(F.map_contains_key(over, k), F.lit(False))), over)
    own = [c for c in records.columns if c not in ("status", "response_id", "merged_headers")]
    return out.select(*own, status.alias("status"), F.col(response).alias("response_id"), F.when(status == "resolved", merged).alias("merged_headers"))


def records_of(pages: DataFrame) -> DataFrame:
    """Capture records of a table of pages: for each row a full response at second 60 * page_id, and a not-modified revisit of its URL, in another spelling, 36 hours later. Every fifth page's validator has changed; every seventh page gives no ETag."""
    etag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    modified = F.concat(F.lit("day "), (F.col("page_id") % 400).cast("string"))
    no_etag = F.col("page_id") % 7 == 0
    pair = lambda *x: F.map_filter(F.create_map(*x), lambda k, v: v.isNotNull())
    first = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", (60 * F.col("page_id")).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("http_status"),
        pair(F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("date"), F.concat(F.lit("at "), (60 * F.col("page_id")).cast("string")), F.lit("etag"), F.when(~no_etag, etag), F.lit("last-modified"), modified).alias("headers"),
    )
    ts = 60 * F.col("page_id") + 129_600
    again = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), ts.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("http_status"),
        pair(F.lit("content-length"), F.lit("0"), F.lit("date"), F.concat(F.lit("at "), ts.cast("string")), F.lit("etag"), F.when(~no_etag, F.when(F.col("page_id") % 5 == 0, '"changed"').otherwise(F.concat(F.lit("W/"), etag))), F.lit("last-modified"), F.when(F.col("page_id") % 5 == 0, "changed").otherwise(modified)).alias("headers"),
    )
    return first.union(again)


def report(pages: DataFrame) -> DataFrame:
    """For each revisit: record_id, status, response_id and the merged headers as sorted lines."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return resolve_revisits(records_of(pages)).select("record_id", "status", "response_id", lines.alias("merged_headers"))


ORACLE = r"""
with k as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') bare from pages),
c as (select page_id, html, regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)?$', '') host, regexp_extract(bare, '^[^/?]*([^?]*)', 1) path,
 list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x != '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) q from k),
p as (select page_id, host || case when path = '' then '/' else path end || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end u,
 '"' || md5(html) || '"' tag, page_id % 7 = 0 bare, 'day ' || page_id % 400 as dayn, strlen(html) bytes from c),
j as (select r.page_id, r.tag rtag, r.bare rbare, r.dayn rday, s.page_id sid, s.tag stag, s.bare sbare, s.dayn sday, s.bytes,
 case when r.page_id % 5 = 0 then '"changed"' else r.tag end vtag, case when r.page_id % 5 = 0 then 'changed' else r.dayn end vday,
 row_number() over (partition by r.page_id order by s.page_id desc) n
 from p r left join p s on s.u = r.u and 60 * s.page_id < 60 * r.page_id + 129600),
t as (select *, case when sid is null then 'no_earlier' when not rbare and not sbare then case when vtag = stag then 'resolved' else 'validator_mismatch' end when vday = sday then 'resolved' else 'validator_mismatch' end status from j where n = 1)
select 2 * page_id + 1 record_id, status, 2 * sid response_id, case when status = 'resolved' then
 'content-length: ' || bytes || chr(10) || 'date: at ' || (60 * page_id + 129600)
 || case when not rbare then chr(10) || 'etag: W/' || vtag when not sbare then chr(10) || 'etag: ' || stag else '' end || chr(10) || 'last-modified: ' || vday end merged_headers
from t"""
