"""Outcomes of lookups, and what is counted of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom import constants as C
from linkloom.functions.urls import canonical, null_header

#: Order of the fields in outputs.
VERIFIED = ("url", "size", "etag", "content_type", "last_modified", "version_id", "replication_status", "encryption", "server", "status", "checked_at")
DEAD = ("url", "status", "error_type", "checked_at")


def header(name: str) -> Column:
    """By name in any case."""
    low = F.map_filter("headers", lambda k, _: F.lower(k) == name.lower())
    return F.get(F.map_values(low), F.lit(0))


def canonical_set(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct canonical URLs of lines, blanks dropped."""
    return lines.select(canonical(F.col(column)).alias("url")).where("url <> ''").distinct()


def latest(responses: DataFrame) -> DataFrame:
    """One response for each request_url: the latest by fetched_at (none: earliest), then by status; combined before the shuffle."""
    others = [c for c in responses.columns if c != "request_url"]
    at = F.struct(F.coalesce("fetched_at", F.timestamp_seconds(F.lit(0))), F.coalesce("status", F.lit(-1)))
    return responses.groupBy("request_url").agg(F.max_by(F.struct(*others), at).alias("r")).select("request_url", "r.*")


def classified(urls: DataFrame, responses: DataFrame) -> DataFrame:
    """urls: url; responses: request_url, status, error (timeout or other), headers, fetched_at. All URLs with their outcome.

    A URL without a response is dead by network; of several responses the latest counts. Only 200 is live.
    """
    found = urls.join(latest(responses).withColumnRenamed("request_url", "_asked"), F.col("url") == F.col("_asked"), "left")
    text = lambda name: F.coalesce(header(name), F.lit(""))
    live = F.coalesce(F.col("status") == 200, F.lit(False))
    error = F.when(live, F.lit(None).cast("string")).when(F.col("status").isNotNull(), "http").when(F.col("error") == "timeout", "timeout").otherwise("network")
    return found.select(
        "url", live.alias("live"), F.coalesce(header("content-length").try_cast("bigint"), F.lit(0)).alias("size"),
        text("etag").alias("etag"), text("content-type").alias("content_type"), text("last-modified").alias("last_modified"),
        null_header(header("x-amz-version-id")).alias("version_id"), null_header(header("x-amz-replication-status")).alias("replication_status"),
        null_header(header("x-amz-server-side-encryption")).alias("encryption"), text("server").alias("server"),
        F.col("status").cast("int").alias("status"), error.alias("error_type"),
        F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("checked_at"),
    )


def verified(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("live").select(*VERIFIED)


def dead(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("NOT live").select(*DEAD)


def run_stats(outcomes: DataFrame, total: int | None = None) -> DataFrame:
    """total_urls (gated, or as given), unique_urls, live, dead."""
    n = F.count("*")
    return outcomes.agg((n if total is None else F.lit(total)).cast("bigint").alias("total_urls"), n.alias("unique_urls"), F.count_if("live").alias("live"), F.count_if(~F.col("live")).alias("dead"))


def asked_key(request_url: Column) -> Column:
    """What a request stands for: the canonical URL, whether that was asked for itself or at the origin."""
    return F.regexp_replace(canonical(request_url), C.ORIGIN, "https://")


def there(responses: DataFrame, key: str = "request_url") -> DataFrame:
    """responses: the key, status, fetched_at. The keys whose latest response, as of latest(), is 200: the last 200 is later than any
    greater status, and not earlier than any other. These are times alone, so they are combined by hashing, without a sort."""
    at, status = F.coalesce("fetched_at", F.timestamp_seconds(F.lit(0))), F.coalesce("status", F.lit(-1))
    last = responses.groupBy(key).agg(F.max(F.when(status == 200, at)).alias("good"), F.max(F.when(status > 200, at)).alias("greater"), F.max(F.when(status < 200, at)).alias("less"))
    return last.where("good IS NOT NULL AND (greater IS NULL OR good > greater) AND (less IS NULL OR good >= less)").select(key)


def existing(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """Candidates whose latest response, of the origin or the host, is 200; names may be written with or without escapes."""
    # columns of their own that are never null: a join by an expression would work it out anew in each comparison of its sort, and of a
    # key that may be null Spark would ask that first, in a filter whose code is too large to be compiled; missing ones meet nothing
    heads = responses.select(F.coalesce(asked_key(F.col("request_url")), F.lit("\0there")).alias("_there"), "status", "fetched_at")
    keyed = candidates.withColumn("_key", F.coalesce(canonical(F.col("url")), F.lit("\0key")))
    return keyed.join(there(heads, "_there"), F.col("_key") == F.col("_there"), "left_semi").drop("_key")


def unseen(urls: DataFrame, known: DataFrame) -> DataFrame:
    return urls.join(known.select("url"), "url", "left_anti")


def source_counts(rows: DataFrame) -> DataFrame:
    """rows: source, url (raw). Distinct raw and canonical URLs by source, and over all sources (source null).

    Totals are sums over sources, with URLs of several sources counted in each; global_unique counts them once.
    """
    pairs = rows.withColumn("canonical", canonical(F.col("url")))
    each = pairs.groupBy("source").agg(F.count_distinct("url").alias("raw"), F.count_distinct(F.when(F.col("canonical") != "", F.col("canonical"))).alias("unique"))
    once = pairs.where("canonical <> ''").agg(F.count_distinct("canonical").alias("global_unique"))
    total = each.agg(F.sum("raw").alias("raw"), F.sum("unique").alias("unique")).crossJoin(once)
    return each.withColumn("global_unique", F.lit(None).cast("bigint")).unionByName(total.select(F.lit(None).cast("string").alias("source"), "raw", "unique", "global_unique"))


def source_overlap(rows: DataFrame) -> DataFrame:
    """How many canonical URLs each pair of sources shares. Pairs are made within a URL's sources, of which there are few."""
    held = rows.select(canonical(F.col("url")).alias("url"), "source").where("url <> ''").groupBy("url").agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return held.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("source_a"), F.col("p.b").alias("source_b")).agg(F.count("*").alias("shared"))


def first_seen(rows: DataFrame) -> DataFrame:
    """rows: url, run_id, source. Each URL's first run, and in it the first source."""
    return rows.groupBy("url").agg(F.min(F.struct("run_id", "source")).alias("m")).select("url", "m.run_id", "m.source")


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """change (added, removed), url."""
    added = after.select("url").distinct().join(before.select("url"), "url", "left_anti").select(F.lit("added").alias("change"), "url")
    removed = before.select("url").distinct().join(after.select("url"), "url", "left_anti").select(F.lit("removed").alias("change"), "url")
    return added.union(removed)


def keep_first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows with the same key the first in order; combined before any shuffle."""
    others = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.min(F.struct(*order, *others)).alias("m")).select(key, "m.*")
