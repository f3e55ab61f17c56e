"""WARC not-modified revisits: each is resolved to the latest earlier full response of the same canonical URL.

Records are rows (record_id, kind, url, ts, status, etag, last_modified, digest, headers) with kind `response` or
`revisit`; `headers` is a map with lower-case names. `resolve` is an as-of join in two levels, so that no task grows
with a hot URL: time is cut into about `SLICES` ranges of equal numbers of records, by quantiles, so that neither a burst
nor a stray time makes a range large; the latest response of each URL and range is found first, the latest
earlier range that has one comes from a window over those few rows, and rows of one range alone are ordered together.

A found response confirms a revisit if the validators that both have agree (entity tag, compared weakly; else the time
of last modification; else the payload digest). Its headers are then taken over, replaced by those of the revisit that
a not-modified answer may carry (`PERMITTED`).

Outcomes: `resolved`; `mismatch` (a validator differs; nothing is merged); `unverified` (no validator on both sides;
merged); `orphan` (no earlier response). Of several responses at the latest time the one with the largest record_id
counts; a response at the revisit's own time is not earlier. Defined cases: a null URL or time is an orphan; URLs
without `://` are compared as they are; null headers are empty; a null page is an answer of 0 bytes; very long pages are only measured and hashed; repeated revisits are resolved each; other kinds of
record and rows without a kind are left out; an empty table gives an empty table; other input columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.session import stored

SLICES = 1024
#: Headers that a not-modified answer may carry or renew (fixed values of the HTTP standard).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that do not tell pages apart.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical(url: str | Column) -> Column:
    """Scheme, `www.`, default port, fragment, tracking parameters and a trailing slash left out; host lower-cased."""
    u = F.col(url) if isinstance(url, str) else url
    bare = F.regexp_replace(u, "#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    query = F.regexp_replace(F.concat(F.lit("&"), query), rf"&{TRACKING}=[^&]*", "")
    query = F.regexp_replace(query, "^&|&$", "")
    known = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(F.instr(u, "://") > 0, known).otherwise(u)


def _weak(tag: str) -> Column:
    return F.regexp_replace(F.col(tag), "^W/", "")


def sliced(rows: DataFrame) -> DataFrame:
    """`rows` with `slice`, the range of `ts` in which a row lies; equal times lie in one slice, whatever their number."""
    rows = rows.withColumn("at", F.col("ts").cast("double"))
    cuts = rows.approxQuantile("at", [i / SLICES for i in range(1, SLICES)], 1 / SLICES)
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    if len(splits) < 3:
        return rows.withColumn("slice", F.lit(0.0)).drop("at")
    return Bucketizer(splits=splits, inputCol="at", outputCol="slice", handleInvalid="keep").transform(rows).drop("at")


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, url_key, ts, source_id, source_ts, outcome, status, headers) of every revisit."""
    rows = records.select("record_id", "kind", canonical("url").alias("url_key"), "ts", "status", "etag", "last_modified", "digest", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    rows = rows.where(F.col("kind").isin("response", "revisit"))
    rows = stored(sliced(rows), "records")
    asked = rows.where("kind = 'revisit'")
    key = F.struct("ts", "record_id")
    full = rows.where("kind = 'response' AND url_key IS NOT NULL AND ts IS NOT NULL")
    # the last response of each URL in each slice, then the last one before each slice in which the URL occurs
    ends = stored(rows.where("url_key IS NOT NULL AND ts IS NOT NULL").groupBy("url_key", "slice").agg(F.max(F.when(F.col("kind") == "response", key)).alias("end")), "ends")
    before = F.last("end", ignorenulls=True).over(W.partitionBy("url_key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    before = ends.select("url_key", "slice", before.alias("before"))
    # inside a slice, rows with equal times see only what lies strictly before them
    slim = rows.where("url_key IS NOT NULL AND ts IS NOT NULL").select("url_key", "slice", "ts", "record_id", "kind")
    seconds = slim.groupBy("url_key", "slice", "ts").agg(F.max(F.when(F.col("kind") == "response", key)).alias("at"))
    inside = F.last("at", ignorenulls=True).over(W.partitionBy("url_key", "slice").orderBy("ts").rowsBetween(W.unboundedPreceding, -1))
    seen = seconds.select("url_key", "slice", "ts", inside.alias("inside")).join(before, ["url_key", "slice"])
    seen = seen.select("url_key", "ts", F.coalesce("inside", "before").alias("found")).where("found IS NOT NULL")
    seen = stored(seen.select("url_key", "ts", F.col("found.record_id").alias("source_id"), F.col("found.ts").alias("source_ts")), "seen")
    linked = asked.join(seen, ["url_key", "ts"], "left")
    source = full.select(F.col("record_id").alias("source_id"), F.col("url_key").alias("_u"), F.col("ts").alias("_t"), F.col("status").alias("s_status"), F.col("etag").alias("s_etag"), F.col("last_modified").alias("s_modified"), F.col("digest").alias("s_digest"), F.col("headers").alias("s_headers"))
    # repeated responses with one id, URL and time: the largest counts
    source = source.groupBy("source_id", F.col("_u"), F.col("_t")).agg(F.max(F.struct("s_status", "s_etag", "s_modified", "s_digest", F.array_sort(F.map_entries("s_headers")).alias("h"))).alias("v"))
    source = stored(source.select("source_id", "_u", "_t", "v.s_status", "v.s_etag", "v.s_modified", "v.s_digest", F.map_from_entries("v.h").alias("s_headers")), "sources")
    s = source.withColumnRenamed("source_id", "_id")
    joined = linked.join(s, (F.col("source_id") == F.col("_id")) & (F.col("url_key") == F.col("_u")) & (F.col("source_ts") == F.col("_t")), "left")
    same = F.coalesce(F.regexp_replace("s_etag", "^W/", "") == _weak("etag"), F.col("s_modified") == F.col("last_modified"), F.col("s_digest") == F.col("digest"))
    outcome = F.when(F.col("source_id").isNull(), "orphan").when(same, "resolved").when(~same, "mismatch").otherwise("unverified")
    renewed = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    kept = F.map_filter("s_headers", lambda k, _: ~F.array_contains(F.map_keys(renewed), k))
    merged = F.when(outcome.isin("resolved", "unverified"), F.map_concat(kept, renewed)).otherwise(F.col("headers"))
    status = F.when(outcome.isin("resolved", "unverified"), F.col("s_status")).otherwise(F.col("status"))
    return joined.select("record_id", "url_key", "ts", "source_id", "source_ts", outcome.alias("outcome"), status.alias("status"), merged.alias("headers"))


def records_of(pages: DataFrame) -> DataFrame:
    """A crawl made of `pages`: each row is a full response, followed later by a not-modified revisit of the same URL.

    The page's id is its time; the revisit comes a hash of the URL mod 997 and a half later, so that another capture of the
    same canonical URL may lie between them, and has the entity tag of its own page.
    """
    tag, day = F.sha2(F.coalesce("html", F.lit("")), 256), F.col("page_id") * 2
    later = day + 2 * (F.conv(F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 8), 16, 10).cast("long") % 997) + 1

    def row(kind: str, id_: Column, ts: Column, status: int, headers: Column):
        return F.struct(id_.alias("record_id"), F.lit(kind).alias("kind"), "url", ts.alias("ts"), F.lit(status).alias("status"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), tag.alias("digest"), headers.alias("headers"))

    first = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), day.cast("string"), F.lit("content-length"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"))
    again = F.create_map(F.lit("date"), later.cast("string"), F.lit("content-length"), F.lit("0"), F.lit("etag"), tag)
    both = F.array(row("response", F.col("page_id") * 2, day, 200, first), row("revisit", F.col("page_id") * 2 + 1, later, 304, again))
    return pages.select(F.explode(both).alias("r")).select("r.*")
