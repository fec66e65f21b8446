"""WARC not-modified revisits: as-of join by canonical URL to the latest earlier full response.

A records table has: record_id string, warc_type string, target_uri string, warc_date long (seconds), http_status int, headers map<string, string>.
A revisit that a server answered with 304 has no payload of its own; it stands for the latest full response (status 200) of the same canonical URL whose date is
earlier. Its validators must agree with that response's: the ETag by weak comparison if the revisit has one, else Last-Modified. If they
don't, what was stored isn't what the server spoke of, and the revisit stays unresolved.

The as-of join holds for URLs of any frequency: records are range-partitioned by (URL, date), so a hot URL spreads over many partitions;
each partition answers its own revisits with a running maximum, and what it hands on is one row per URL and partition. Records of one URL and date stay
together, so "earlier" is strict across partitions too. The partitioned records are written before they are used twice.

Outcomes: resolved; no-url (null or unreadable); no-response (none earlier); no-validator (the revisit has none); changed (a validator differs). Null dates: a response
without one is never earlier, a revisit without one finds none. Null or missing headers: none. Ties in date among responses: the largest record_id. Repeated
rows: each revisit row gives a row. Empty table: empty result. Further columns ride in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# Header fields that a 304 response doesn't replace in a stored response (RFC 9110, RFC 9111: hop-by-hop fields and those of the message's own framing).
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that say where a reader came from, not what is read.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)="
PARTITION_ROWS = 50_000


def canonical_url(url: Column) -> Column:
    """Host without www., path without a final slash, and sorted query parameters without those for tracking; no scheme, port or fragment. Null if there is no host."""
    host = F.regexp_extract(F.lower(url), r"^[a-z]+://([^/?#:]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[a-zA-Z]+://[^/?#]*", "")
    path = F.rtrim(F.regexp_replace(rest, r"\?.*$", ""), F.lit("/"))
    params = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.when(path == "", "/").otherwise(path), query))


def _headers(headers: Column) -> Column:
    """Header fields as sorted (name in lower case, value) entries; of one name the last value by order."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
    return F.coalesce(F.array_sort(entries), F.array().cast("array<struct<name:string,value:string>>"))


def _field(entries: Column, name: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["name"] == name), 0)["value"]


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, refers_to (record_id of the response, if resolved), outcome, and merged (sorted header entries, if resolved)."""
    rows = records.select(
        "record_id", F.col("warc_date").cast("long").alias("date"), canonical_url(F.col("target_uri")).alias("key"), _headers(F.col("headers")).alias("h"),
        ((F.col("warc_type") == "response") & (F.col("http_status") == 200)).alias("full"), ((F.col("warc_type") == "revisit") & (F.col("http_status") == 304)).alias("revisit"),
    ).where("full OR revisit")
    joinable = rows.where(F.col("key").isNotNull() & F.col("date").isNotNull())
    parts = max(1, -(-records.count() // PARTITION_ROWS))
    placed = written(joinable.repartitionByRange(parts, "key", "date").withColumn("part", F.spark_partition_id()), "warc-ranges")

    answer = F.when(F.col("full"), F.struct("date", "record_id", "h"))
    earlier = Window.partitionBy("part", "key").orderBy("date").rangeBetween(Window.unboundedPreceding, -1)
    here = placed.withColumn("found", F.max(answer).over(earlier)).where("revisit")
    handed = placed.groupBy("key", "part").agg(F.max(answer).alias("last"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition that the URL spans
    handed = handed.withColumn("last", F.max("last").over(before)).where(F.col("last").isNotNull()).select(F.col("key").alias("k2"), F.col("part").alias("p2"), "last")
    joined = here.join(handed, (F.col("key") == F.col("k2")) & (F.col("part") == F.col("p2")), "left").withColumn("found", F.coalesce("found", "last"))

    alone = rows.where(F.col("revisit") & (F.col("key").isNull() | F.col("date").isNull())).withColumn("found", F.lit(None).cast(joined.schema["found"].dataType))
    all_of = joined.select("record_id", "key", "h", "found").unionByName(alone.select("record_id", "key", "h", "found"))

    tag, modified = _field(F.col("h"), "etag"), _field(F.col("h"), "last-modified")
    old_tag, old_modified = _field(F.col("found.h"), "etag"), _field(F.col("found.h"), "last-modified")
    weak = lambda t: F.regexp_replace(t, "^W/", "")
    outcome = (
        F.when(F.col("key").isNull(), "no-url").when(F.col("found").isNull(), "no-response").when(tag.isNull() & modified.isNull(), "no-validator")
        .when(tag.isNotNull() & ~weak(tag).eqNullSafe(weak(old_tag)), "changed").when(tag.isNull() & ~modified.eqNullSafe(old_modified), "changed").otherwise("resolved")
    )
    fresh = F.filter("h", lambda e: ~e["name"].isin(*NOT_MERGED))
    replaced = F.transform(fresh, lambda e: e["name"])
    merged = F.array_sort(F.concat(fresh, F.filter("found.h", lambda e: ~F.array_contains(replaced, e["name"]))))
    judged = all_of.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return judged.select("record_id", F.col("key").alias("url_key"), F.when(resolved, F.col("found.record_id")).alias("refers_to"), "outcome", F.when(resolved, merged).alias("merged"))


def revisit_report(records: DataFrame) -> DataFrame:
    """resolve_revisits with the merged header as text, a field a line."""
    lines = F.array_join(F.transform("merged", lambda e: F.concat(e["name"], F.lit(": "), e["value"])), "\n")
    return resolve_revisits(records).select("record_id", "url_key", "refers_to", "outcome", F.when(F.col("merged").isNotNull(), lines).alias("headers"))


def archive_of_pages(pages: DataFrame) -> DataFrame:
    """A records table from crawled pages: each page is a full response, and each was asked for once more and answered with 304.

    Dates, validators and lengths come from the page itself. The second request comes up to a week after or a day before; it names the page by its ETag (weak over https), by Last-Modified
    where the URL has a query, and by an outdated ETag where it has a fragment.
    """
    url, page_id = F.col("url"), F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    size = F.octet_length("html").cast("long")
    date = F.lit(1704067200).cast("long") + 60 * page_id
    again = date + 60 * (size % 10080) - 86400
    text = lambda c: c.cast("string")
    old = F.create_map(
        F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), text(size), F.lit("Date"), text(date), F.lit("ETag"), tag,
        F.lit("Last-Modified"), text(date - 3600), F.lit("Server"), F.lit("archive"), F.lit("X-Cache"), F.lit("stored"),
    )
    named = F.when(F.contains(url, F.lit("#")), F.concat(F.lit('"'), F.md5(url), F.lit('"'))).when(~F.contains(url, F.lit("?")), F.when(F.startswith(url, F.lit("https")), F.concat(F.lit("W/"), tag)).otherwise(tag))
    new = F.create_map(
        F.lit("Date"), text(again), F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("ETag"), named, F.lit("Last-Modified"), F.when(F.contains(url, F.lit("?")), text(date - 3600)),
        F.lit("Connection"), F.lit("close"), F.lit("Content-Length"), F.lit("0"), F.lit("X-Cache"), F.lit("revalidated"),
    )
    new = F.map_filter(new, lambda _, v: v.isNotNull())
    response = F.struct(F.concat(F.lit("response-"), text(page_id)).alias("record_id"), F.lit("response").alias("warc_type"), date.alias("warc_date"), F.when(F.col("html").isNotNull(), 200).alias("http_status"), old.alias("headers"))
    revisit = F.struct(F.concat(F.lit("revisit-"), text(page_id)).alias("record_id"), F.lit("revisit").alias("warc_type"), again.alias("warc_date"), F.lit(304).alias("http_status"), new.alias("headers"))
    return pages.select(url.alias("target_uri"), F.explode(F.array(response, revisit)).alias("r")).select("r.record_id", "r.warc_type", "target_uri", "r.warc_date", "r.http_status", "r.headers")
