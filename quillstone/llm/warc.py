"""Not-modified revisit resolution for web archives (operator 1).

A crawler that is told "304 Not Modified" stores a *revisit* record without a
body.  Resolution is an as-of join: by canonical URL, to the latest earlier
full response in the order ``(ts, record_id)``.  The pair's validators are then
compared (entity tags weakly, else modification dates); a confirmed revisit
takes the stored response's headers, overwritten by those that a 304 may update.

The as-of join never holds one URL in one task.  Time is cut at quantiles into
slices, ``SLICES`` or as many as the most frequent URL needs for about
``SLICE_ROWS`` rows each; records without URL or time take no part in it.  Within (URL, slice) a window carries the last full response
forward, and one row per (URL, slice) carries it across slices.  Bodies do not
take part: :func:`attach_payload` joins them at the end, by record id.

Outcomes: ``response`` (a full response, unchanged), ``resolved``,
``unverified`` (no validator in common, so nothing confirms the pair: not
referred, own headers kept), ``validator_mismatch``, ``orphan`` (no earlier full response), ``no_url``,
``no_time``.  Null headers are empty headers; header names compare without
case; two records of equal time are ordered by record id; repeated records are
each resolved; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES, MOST_SLICES = 32, 4_096
SLICE_ROWS = 100_000
#: Headers that a 304 response may replace (fixed values, RFC 9110 section 15.4.5 and RFC 9111 section 3.2).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not select content (fixed values).
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|sessionid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """Canonical form: no scheme, user, default port, ``www.``, fragment or tracking; sorted query."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(F.lit("/"))
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.when(F.trim(url) != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def _lower_keys(headers: Column) -> Column:
    pairs = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value")))
    # the first of names that differ in case only
    keys = F.array_distinct(F.transform(pairs, lambda e: e.key))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda e: e.key == k), 1).value))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Resolve ``records(record_id, record_type, url, ts, headers)``.

    ``record_type`` is ``response`` or ``revisit``.  Returns ``record_id,
    record_type, canonical_url, ts, outcome, refers_to, headers``; ``refers_to``
    is the id of the response whose body the record has, null if none.
    """
    r = records.select(
        F.col("record_id").cast("long").alias("record_id"), "record_type", canonical_url(F.col("url")).alias("canonical_url"), "ts", _lower_keys(F.col("headers")).alias("headers")
    )
    dated = r.where("ts is not null and canonical_url is not null")
    most = dated.groupBy("canonical_url").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n = min(MOST_SLICES, max(SLICES, -(-most // SLICE_ROWS)))
    cuts = dated.select(F.unix_micros("ts").alias("t")).approxQuantile("t", [i / n for i in range(1, n)], 0.1 / n)
    cuts = F.lit([int(c) for c in sorted(set(cuts))]).cast("array<long>")
    at = F.aggregate(cuts, F.lit(0), lambda k, c: k + (F.unix_micros("ts") >= c).cast("int"))
    aside = r.where("ts is null or canonical_url is null").withColumn("base", F.lit(None).cast("struct<record_id:bigint,headers:map<string,string>>"))
    full = F.col("record_type") == "response"
    r = dated.withColumn("slice", at).withColumn("own", F.when(full, F.struct("record_id", "headers")))
    near = Window.partitionBy("canonical_url", "slice").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("near", F.last("own", ignorenulls=True).over(near))
    ends = r.where("own is not null").groupBy("canonical_url", "slice").agg(F.max(F.struct("ts", "record_id")).alias("at"), F.max_by("own", F.struct("ts", "record_id")).alias("end"))
    grid = r.select("canonical_url", "slice").distinct().join(ends, ["canonical_url", "slice"], "left")
    far = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select("canonical_url", "slice", F.last("end", ignorenulls=True).over(far).alias("far"))
    j = r.join(grid, ["canonical_url", "slice"], "left").withColumn("base", F.coalesce("near", "far")).select(*aside.columns).unionByName(aside)
    mine, theirs = F.col("headers"), F.col("base.headers")
    day = F.lit("last-modified")
    by_tag = _tag(mine) == _tag(theirs)
    by_day = F.try_element_at(mine, day) == F.try_element_at(theirs, day)
    same = F.coalesce(by_tag, by_day)
    outcome = (
        F.when(F.col("record_type") == "response", "response")
        .when(F.col("canonical_url").isNull(), "no_url")
        .when(F.col("ts").isNull(), "no_time")
        .when(F.col("base").isNull(), "orphan")
        .when(same.isNull(), "unverified")
        .when(same, "resolved")
        .otherwise("validator_mismatch")
    )
    update = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(update, k)), update)
    j = j.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    return j.select(
        "record_id", "record_type", "canonical_url", "ts", "outcome",
        F.when(F.col("outcome") == "response", F.col("record_id")).when(ok, F.col("base.record_id")).alias("refers_to"),
        F.when(ok, merged).otherwise(mine).alias("headers"),
    )


def attach_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Add ``payload`` from ``payloads(record_id, payload)`` by ``refers_to``; null if unresolved."""
    p = payloads.select(F.col("record_id").alias("refers_to"), "payload")
    return resolved.join(p, "refers_to", "left")
