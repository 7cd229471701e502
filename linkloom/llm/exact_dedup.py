"""Exact dedup by skew-safe combining.

Three stages, all of them grouping by digest and full content, so that no stage trusts a digest alone: rows are combined
where they are read (Spark's map-side aggregation), the combined rows meet in salted digest groups, and the winners of
the salts meet in one group for each digest. A group of copies of any size thus leaves each task as one row for each salt.
Where rows meet their group again, groups of over 1/SHARES of all rows are dealt to several keys, so that no key has more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import small_batches, texts, utf8, written

SALTS = 8
#: No key of the last join has over this part of all rows; so many digests are broadcast at most (some 50 bytes each).
SHARES = 4096


def sha256(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


def digest_of(text: Column, digest: Callable[[bytes], bytes] = sha256) -> Column:
    """Of the text with A-Z lower-cased, in UTF-8; null counts as empty."""
    def each(column: pa.Array) -> pa.Array:
        return pa.array([digest(t.lower()) for t in utf8(column)], pa.binary())  # on bytes, lower() knows A-Z only

    return F.arrow_udf(each, "binary")(F.coalesce(text.cast("string"), F.lit("")))


def normalised(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; null counts as empty."""
    def each(column: pa.Array) -> pa.Array:
        return pa.array([t.lower() for t in utf8(column)], pa.binary()).cast(pa.string())

    return F.arrow_udf(each, "string")(F.coalesce(text.cast("string"), F.lit("")))


def groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """rows: doc_id, digest, content. For each digest: keep_id, group_size and, only if different contents share the
    digest, `contents` with the same for each of them."""
    salt = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(salts)).cast("int")
    local = rows.groupBy("digest", "content", salt.alias("salt")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    winners = local.repartition("digest").groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    each = F.collect_list(F.struct("content", "keep_id", F.col("n").alias("group_size")))
    several = F.count("*") > 1
    # of a digest's contents (one, unless digests collide) the text is kept only where it is needed to tell rows apart
    return winners.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.when(several, each).alias("contents"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id (the largest doc_id among equal texts), group_size, kept, digest.

    Texts are equal if they are after lower-casing A-Z; null counts as empty, and empty texts are equal. Rows that repeat
    a doc_id with the same text each count in group_size; of these, all have kept = true if theirs is the id that stays.
    A null doc_id loses to any other; a group of null ids has keep_id null and kept true. Extra columns of docs play no
    part. An empty table gives an empty one. Very long texts are compared whole. Texts whose digests collide are told apart by their content.
    """
    small_batches(docs.sparkSession)
    both = texts(docs, id_col, text_col)
    rows = both.select("doc_id", normalised(F.col("text")).alias("content"), digest_of(F.col("text"), digest).alias("digest"))
    found, _ = written(groups(rows, salts), "groups")
    total = found.agg(F.sum("group_size")).first()[0] or 0
    keys = F.ceil(F.col("group_size") * SHARES / F.lit(max(total, 1))).cast("int")
    one = found.where(F.col("contents").isNull()).withColumn("keys", keys).select(F.col("digest").alias("of"), "keep_id", "group_size", "keys")
    large = F.broadcast(one.where("keys > 1").select(F.col("of").alias("large"), "keys"))
    # by the task as well, or rows without an id would share a key
    nth = F.pmod(F.xxhash64(F.lit(13), "doc_id", F.spark_partition_id()), F.coalesce("keys", F.lit(1))).cast("int")
    # null-safe, though no digest is null: for a plain equality Spark would filter by a digest of its own before
    dealt = both.select("doc_id", digest_of(F.col("text"), digest).alias("digest")).join(large, F.expr("digest <=> large"), "left").select("doc_id", "digest", nth.alias("nth"))
    spread = one.select("of", "keep_id", "group_size", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("of_nth"))
    out = dealt.join(spread, F.expr("digest <=> of AND nth <=> of_nth")).drop("of", "nth", "of_nth")
    mixed = found.where(F.col("contents").isNotNull())
    if mixed.limit(1).count():
        apart = mixed.select("digest", F.inline("contents"))
        out = out.unionByName(rows.join(apart, ["digest", "content"]).select("digest", "doc_id", "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
