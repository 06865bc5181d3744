"""Web archive records: not-modified revisits resolved to the response they stand for.

A revisit record says that a page had not changed; its body is that of the latest earlier full
response (status 200) for the same canonical URL.  The join is as-of in time.  It is resolved in two
levels so that a URL with a third of all records is no single task's work: records are windowed by
(URL, block of time), the last response of each block is found by a partial aggregate, and a window
over the blocks - as many per URL as the time span has - hands it to later blocks.  Only ids,
validators and headers travel; bodies stay with their records.

A response is accepted if a validator of the revisit agrees: equal strong or weak entity tags, or
else an equal last-modified time; a revisit without validators is resolved by its payload digest, or
unconditionally when it has none.  The merged headers are the response's, replaced by those of the
revisit that a not-modified answer may update (``PERMITTED``).

Defined cases: null URL or time = unresolved (``no_url``, ``no_time``); ties of time go to the larger
record id; a response at the revisit's own time counts as earlier; repeated rows are resolved each;
null headers are empty; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified answer may update, in lower case.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Seconds per block of time.
BLOCK_S = 86_400
#: Query parameters that name a visit, not a page.
VISIT_PARAMETERS = "ref|utm_[a-z]+|sessionid|sid|phpsessionid|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Lower-case host without ``www.`` or ``m.``, default port, user, fragment, visit parameters or trailing slash; one scheme; parameters sorted."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www\d*|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^({VISIT_PARAMETERS})(=|$)")))
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of a name given twice the last value stays."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))


def resolve(records: DataFrame, block_s: int = BLOCK_S) -> DataFrame:
    """``records``: record_id, kind (``response`` or ``revisit``), url, at (timestamp), status, headers (map), digest.

    One row per revisit: record_id, canonical_url, at, resolved_id, outcome (resolved, changed, no_earlier, no_url, no_time), headers.
    """
    r = records.select(
        "record_id", "kind", canonical_url(F.col("url")).alias("key"), F.col("at").cast("timestamp").cast("long").alias("s"), "at",
        "status", lower_keys(F.col("headers")).alias("headers"), "digest")
    r = r.where((F.col("kind") == "revisit") | (F.col("kind") == "response") & (F.col("status") == 200) & F.col("key").isNotNull() & F.col("s").isNotNull())
    response = F.when(F.col("kind") == "response", F.struct("s", "record_id", "headers", "digest"))
    r = r.withColumn("block", F.floor(F.col("s") / block_s)).withColumn("own", response)
    known = r.where(F.col("key").isNotNull() & F.col("s").isNotNull())
    inside = Window.partitionBy("key", "block").orderBy("s", F.when(F.col("kind") == "response", 0).otherwise(1), "record_id").rowsBetween(Window.unboundedPreceding, 0)
    x = known.withColumn("found", F.last("own", ignorenulls=True).over(inside)).where("kind = 'revisit'")
    blocks = known.groupBy("key", "block").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.struct("s", "record_id"))).alias("last"), F.max(F.col("kind") == "revisit").alias("asked"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("asked and carried is not null").select("key", "block", "carried")
    x = x.join(carried, ["key", "block"], "left").withColumn("found", F.coalesce("found", "carried"))
    rest = r.where("kind = 'revisit' and (key is null or s is null)").withColumn("found", F.lit(None).cast(x.schema["found"].dataType))
    cols = ["record_id", "key", "at", "s", "headers", "digest", "found"]
    x = x.select(*cols).unionByName(rest.select(*cols))
    tag = lambda h: F.regexp_replace(h["etag"], r"^W/", "")
    mine, theirs = F.col("headers"), F.col("found.headers")
    agree = (F.when(tag(mine).isNotNull() & tag(theirs).isNotNull(), tag(mine) == tag(theirs))
             .when(mine["last-modified"].isNotNull() & theirs["last-modified"].isNotNull(), mine["last-modified"] == theirs["last-modified"])
             .when(F.col("digest").isNotNull() & F.col("found.digest").isNotNull(), F.col("digest") == F.col("found.digest")).otherwise(True))
    outcome = F.when(F.col("key").isNull(), "no_url").when(F.col("s").isNull(), "no_time").when(F.col("found").isNull(), "no_earlier").when(agree, "resolved").otherwise("changed")
    update = F.map_filter(mine, lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.map_contains_key(update, k)), update)
    return x.withColumn("outcome", outcome).select(
        "record_id", F.col("key").alias("canonical_url"), "at", F.when(F.col("outcome") == "resolved", F.col("found.record_id")).alias("resolved_id"),
        "outcome", F.when(F.col("outcome") == "resolved", merged).alias("headers"))


def records_of_pages(pages: DataFrame, days: int = 30) -> DataFrame:
    """Capture records that the given pages stand for: each page is a full response on a day and second set by
    its id, and is asked again twice later; the second time, one page in five has a new entity tag."""
    base = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    start = F.lit(1_700_000_000)
    second = F.pmod(F.col("page_id") * 7919, F.lit(days * 86_400))
    visits = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("visit"))
    s = start + second + F.col("visit") * (86_400 * 2 + F.pmod(F.col("page_id"), F.lit(97)) * 3600)
    at = F.timestamp_seconds(s)
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 12), F.when((F.col("visit") == 2) & (F.pmod(F.col("page_id"), F.lit(5)) == 0), "-new").otherwise(""), F.lit('"'))
    headers = F.create_map(
        F.lit("Date"), s.cast("string"), F.lit("ETag"), tag, F.lit("Cache-Control"), F.concat(F.lit("max-age="), (F.col("visit") * 60).cast("string")),
        F.lit("Content-Type"), F.when(F.col("visit") == 0, "text/html").otherwise("text/plain"), F.lit("Server"), F.concat(F.lit("s"), F.col("visit").cast("string")))
    first = F.col("visit") == 0
    return visits.select((F.col("page_id") * 10 + F.col("visit")).alias("record_id"), F.when(first, "response").otherwise("revisit").alias("kind"), "url", at.alias("at"),
                         F.when(first, 200).otherwise(304).alias("status"), headers.alias("headers"), F.when(first, F.col("digest")).alias("digest"))


def resolved_pages(pages: DataFrame) -> DataFrame:
    """Revisits of the pages' records with the headers as sorted ``name: value`` lines."""
    x = resolve(records_of_pages(pages))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return x.select("record_id", "canonical_url", F.unix_seconds("at").alias("at_s"), "resolved_id", "outcome", F.array_join(lines, "\n").alias("headers"))
