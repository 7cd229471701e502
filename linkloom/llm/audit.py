"""How the filters of a corpus interact: what each removes in every order of application, by an incidence matrix product.

A document's outcome under all orders follows from its mask alone (one bit for each filter that it fails). So documents
are counted by part and mask, all of them and those with either label; these histograms are rows of an integer matrix,
which is multiplied by fixed matrices of 32 masks by 600 (order, step) pairs. No document is visited for each order.

What joins documents is small: digests, masks and ids, never texts. The copies of a text meet as counts (combined before
the shuffle); the id that passes is joined by digest and id, so that a text of very many copies is spread over tasks;
labels are joined by id and salt.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import Scratch

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Where labels are joined: rows of one id are spread over so many keys.
SALTS = 8
#: Parts whose products are made at once in a task (600 rows each).
PARTS_AT_ONCE = 64

# The filters' limits.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SIGNS = "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"


def own_failures(text: Column) -> Column:
    """Bits 0 to 3 (filters A to D) of a text, which is not null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    # bound as one element, the words are split once and not for each use
    counted = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"))), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bit = lambda failed, n: F.when(failed, F.lit(1 << n)).otherwise(F.lit(0))
    by_words = F.get(F.transform(F.array(counted), lambda c: bit(c["n"] < LEAST_WORDS, 0) + bit(c["distinct"] * 100 < c["n"] * LEAST_DISTINCT, 1)), F.lit(0))
    return by_words + bit(capitals.cast("long") * 100 > F.length(text).cast("long") * MOST_CAPITALS, 2) + bit(text.rlike(SIGNS), 3)


def label_sets(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic (0 or 1) of ids with either; of repeated labels the largest counts. Null ids and labels do not."""
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0))
    found = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    return found.where("good + toxic > 0")


def histograms(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, mask, n, good, toxic: how many rows of docs there are, and how many of them have the label."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), own_failures(text).alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest"))
    each = scratch.write(rows.groupBy("doc_id", "part", "bits", "digest").agg(F.count("*").alias("n")), "masks")
    first = each.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    least = first.select(F.col("digest").alias("of"), "first_id")
    copies = each.join(least, (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("first_id")), "left")
    # a row that is not the first of its text fails E; one without an id has no smaller one
    masked = copies.select("doc_id", "part", "n", "digest", (F.col("bits") + F.when(F.col("first_id").isNull() & F.col("doc_id").isNotNull(), F.lit(16)).otherwise(F.lit(0))).alias("mask"))
    spread = F.xxhash64("digest")  # rows without an id meet no label and are spread by their text
    salted = masked.withColumn("salt", F.when(F.col("doc_id").isNull(), spread).otherwise(F.pmod(spread, F.lit(SALTS))))
    marks = label_sets(labels).select(F.col("doc_id").alias("labelled"), "good", "toxic", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("s"))
    known = salted.join(marks, (F.col("doc_id") == F.col("labelled")) & (F.col("salt") == F.col("s")), "left")
    total = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return known.groupBy("part", "mask").agg(total("good"), total("toxic"), F.sum("n").alias("n"))


@cache
def matrices() -> dict[str, np.ndarray]:
    """Of each outcome the 32-by-600 matrix: does a document of this mask have it at this step of this order?"""
    orders = np.array(list(permutations(range(len(FILTERS)))))  # 120 by 5
    bit = 1 << orders
    before = np.cumsum(bit, axis=1) - bit  # the filters already applied
    mask = np.arange(MASKS)[:, None, None]
    fails, earlier = (mask & bit) > 0, (mask & before) > 0
    made = {"kept": ~(fails | earlier), "removed": fails & ~earlier, "redundant": fails & earlier, "unique_fails": (mask == bit) & fails}
    flat = {k: v.reshape(MASKS, -1).astype(np.int64) for k, v in made.items()}
    letter = np.eye(len(FILTERS), dtype=np.int64)[orders.ravel()]  # 600 by 5: the filter of each step
    return flat | {"shapley": flat["removed"] @ letter @ letter.T}


STEPS = [("".join(FILTERS[f] for f in order), step + 1) for order in permutations(range(len(FILTERS))) for step in range(len(FILTERS))]
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
OUT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in OUTCOMES)])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by = matrices()
    orders, steps = pa.array([o for o, _ in STEPS]), np.array([s for _, s in STEPS], np.int32)
    for whole in batches:
        for at in range(0, whole.num_rows, PARTS_AT_ONCE):
            b = whole.slice(at, PARTS_AT_ONCE)
            stacked = np.zeros((3, b.num_rows, MASKS), np.int64)  # all, good, toxic by part and mask
            for i, entries in enumerate(b.column("h").to_pylist()):
                for e in entries:
                    stacked[:, i, e["mask"]] = e["n"], e["good"], e["toxic"]
            every, good, toxic = stacked
            made = {k: every @ m for k, m in by.items()} | {"good_lost": good @ by["removed"], "toxic_lost": toxic @ by["removed"]}
            parts = b.column("part").take(pa.array(np.repeat(np.arange(b.num_rows), len(STEPS))))
            repeated = orders.take(pa.array(np.tile(np.arange(len(STEPS)), b.num_rows)))
            columns = [parts, repeated, pa.array(np.tile(steps, b.num_rows)), *(pa.array(made[c].ravel()) for c in OUTCOMES)]
            yield pa.RecordBatch.from_arrays(columns, schema=OUT)


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs: doc_id, text, source; labels: doc_id, quality, toxic. One row for each part (a source; null: empty), order of the
    five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null and empty texts are empty, so they fail A, and E but for the smallest id. Of rows that share text and smallest id
    all pass E. A row without an id fails E never, is no one's copy and has no label. Repeated rows count each. Very long
    texts are judged whole; extra columns, whatever their names, play no part. An empty table has no parts and gives none.
    """
    found = histograms(docs, labels, Scratch())
    entries = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("h"))  # 32 at most
    return entries.mapInArrow(_products, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in OUTCOMES))
