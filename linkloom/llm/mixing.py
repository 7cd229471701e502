"""Mixing sources to target weights by Pfair scheduling.

Each source's rows form blocks. A source of weight w gets a release time and a deadline for each block: block i (from 0)
is released at floor(i / w) and due at ceil((i + 1) / w), in slots. Earliest deadline first then fills the slots. Weights
are exact fractions, so at every slot of a phase each source has had less than one block more or less than its weight asks
for, however long the phase. When a source runs out, a phase ends, and the sources that are left share its weight in
proportion; so all rows are used, each once. The driver holds three numbers for each block; blocks have BLOCK_DOCS rows,
doubled until there are BLOCKS of them at most (besides one for each source). The slots are joined to the rows by source
and block.

With a period, weights are rounded to fractions of it, and the pattern of one period repeats.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Mapping
from fractions import Fraction
from itertools import repeat
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_DOCS, BLOCKS = 64, 1 << 21
#: Without given weights, a source weighs its rows to this power.
POWER = 0.7
#: Rows of a source that are numbered together in one task, about.
BUCKET_ROWS = 4096
#: Slots and sources up to this number are broadcast (some 30 bytes each), else shuffled.
BROADCAST_ROWS = 1_000_000


def quotas(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole numbers of at least 1 that add up to the period, by largest remainder."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    while (missing := period - sum(out.values())) > 0:
        for s in order[:missing]:
            out[s] += 1
    while (extra := sum(out.values()) - period) > 0:
        for s in sorted((s for s in out if out[s] > 1), key=lambda s: (exact[s] - out[s], s))[:extra]:
            out[s] -= 1
    return out


def pattern(quota: Mapping[str, int], period: int) -> dict[str, list[int]]:
    """Earliest deadline first over one period: the slots of each source's blocks, in order."""
    release = sorted(((i * period) // q, -((-(i + 1) * period) // q), s) for s, q in quota.items() for i in range(q))
    out: dict[str, list[int]] = {s: [] for s in quota}
    ready: list[tuple[int, str]] = []
    at = 0
    for slot in range(period):
        while at < len(release) and release[at][0] <= slot:
            heapq.heappush(ready, release[at][1:])
            at += 1
        due, s = heapq.heappop(ready)
        assert slot < due, "a deadline was missed"
        out[s].append(slot)
    return out


def exact_slots(left: Mapping[str, int], weights: Mapping[str, float]) -> tuple[dict[str, list[int]], int]:
    """Earliest deadline first by the exact weights until a block is missing: the slots of each source's blocks, and how many in all."""
    share = {s: Fraction(weights[s]) for s in left}
    unit = lcm(*(x.denominator for x in share.values()))
    whole = {s: x.numerator * (unit // x.denominator) for s, x in share.items()}
    total = sum(whole.values())
    out: dict[str, list[int]] = {s: [] for s in left}
    waiting: list[tuple[int, int, str]] = [(0, -(-total // w), s) for s, w in whole.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        due, s = heapq.heappop(ready)
        assert slot < due, "a deadline was missed"
        if len(out[s]) == left[s]:
            return out, slot
        out[s].append(slot)
        i = len(out[s])
        heapq.heappush(waiting, (i * total // whole[s], -(-(i + 1) * total // whole[s]), s))
        slot += 1


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], period: int | None = None) -> list[tuple]:
    """(source, first block, blocks, first slot, quota, period, pattern) for each source and phase until all blocks have slots."""
    left, done, start, out = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    while left and period is None:
        slots, end = exact_slots(left, weights)
        out += [(s, done[s], len(x), start, len(x), end, x) for s, x in slots.items() if x]
        for s, x in slots.items():
            done[s] += len(x)
        left = {s: n - len(slots[s]) for s, n in left.items() if n > len(slots[s])}
        start += end
    while left:
        size = max(period, 4 * len(left)) if len(left) > 1 else 1
        quota = quotas({s: weights[s] for s in left}, size)
        slots = pattern(quota, size)
        end = min(n // quota[s] * size + slots[s][n % quota[s]] for s, n in left.items())  # where a block is first missing
        for s, n in list(left.items()):
            took = end // size * quota[s] + sum(x < end % size for x in slots[s])
            if took:
                out.append((s, done[s], took, start, quota[s], size, slots[s]))
            done[s] += took
            left[s] = n - took
            if not left[s]:
                del left[s]
        start += end
    return out


def source_key(source: Column) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def row_hash(docs: DataFrame) -> Column:
    """Of all columns that can be hashed: tells apart rows that share an id or have none, the same in every run."""
    return F.xxhash64(*(docs[f"`{f.name}`"] for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())))


def scheduled(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_docs: int | None = None, period: int | None = None, id_col: str = "doc_id", source_col: str = "source", carry: Column | None = None) -> DataFrame:
    """row (all columns of docs as a struct, or carry in its place), source_key, block, slot, position: rows in the order of position are the mix.

    weights: by source; each source needs a positive one. None: rows of the source to the power POWER. period: weights are
    rounded to fractions of it; None: they are exact. block_docs: rows of a block; None: see above. Within a source,
    rows are dealt to buckets by a hash of the whole row, so that rows that share an id spread like others; a bucket's rows
    come in the order of a hash of doc_id (of the row, where doc_id is null), then of the row, so that a task that is run
    again numbers them alike. Only rows that are equal in all columns share a bucket for certain. Position has gaps only where the last block of a source isn't full; it is
    unique. Null and empty sources are sources like any other, repeated rows are rows like any other, texts of any length
    are only carried, and columns of docs may have any names. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select((F.struct(F.col("*")) if carry is None else carry).alias("row"), source_key(F.col(source_col)).alias("source_key"), F.xxhash64(F.lit(5), F.coalesce(F.col(id_col).cast("long"), row_hash(docs))).alias("h"), F.col(id_col).cast("long").alias("id"), row_hash(docs).alias("tie"))
    counts = {r["k"]: r["n"] for r in docs.groupBy(source_key(F.col(source_col)).alias("k")).agg(F.count("*").alias("n")).collect()}
    if block_docs is None:
        block_docs = BLOCK_DOCS
        while sum(counts.values()) > BLOCKS * block_docs:
            block_docs *= 2
    if weights is None:
        share = {k: n**POWER for k, n in counts.items()}
    else:
        given = {("null" if k is None else f"={k}"): w for k, w in weights.items()}
        if bad := [k for k in counts if not given.get(k, 0) > 0]:
            raise ValueError(f"sources without a positive weight: {bad[:5]}")
        share = {k: given[k] for k in counts}
    number = {k: i for i, k in enumerate(counts)}
    of, block, at = array("q"), array("q"), array("q")
    for s, first, n, start, quota, size, slots in phases({k: -(-n // block_docs) for k, n in counts.items()}, share, period):
        of.extend(repeat(number[s], n))
        block.extend(range(first, first + n))
        at.extend(start + i // quota * size + slots[i % quota] for i in range(n))
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    column = lambda x: pa.array(np.frombuffer(x, np.int64) if len(x) else [], pa.int64())
    slot_of = few(spark.createDataFrame(pa.table({"source_number": column(of), "block": column(block), "slot": column(at)})), len(at))
    sources = pa.table({"source_key": pa.array(list(counts), pa.string()), "source_number": pa.array(list(number.values()), pa.int64()), "buckets": pa.array([-(-n // BUCKET_ROWS) for n in counts.values()], pa.int64())})
    table = few(spark.createDataFrame(sources), len(counts))

    # number the rows of a source without gathering them: by bucket, after the rows of the buckets before it
    sized = rows.join(table, "source_key").withColumn("bucket", F.pmod("tie", "buckets"))
    before = sized.groupBy("source_key", "bucket").agg(F.count("*").alias("n"))
    before = before.select("source_key", "bucket", (F.sum("n").over(Window.partitionBy("source_key").orderBy("bucket")) - F.col("n")).alias("before"))
    numbered = sized.withColumn("nth", F.row_number().over(Window.partitionBy("source_key", "bucket").orderBy("h", "id", "tie")) - 1)
    ranked = numbered.join(before, ["source_key", "bucket"]).withColumn("rank", F.col("before") + F.col("nth"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block_docs)).join(slot_of, ["source_number", "block"])
    return ranked.select("row", "source_key", "block", "slot", (F.col("slot") * block_docs + F.col("rank") % block_docs).alias("position"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with their columns, in the order of the mix (range-partitioned, so that files in order are the mix)."""
    return scheduled(docs, **options).orderBy("position").select("row.*")
