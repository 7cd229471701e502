"""Best-fit packing into sequences of several permitted lengths.

Documents are cut at the largest permitted length; full pieces are sequences as they are. What remains of each document
is packed best-fit, longest first, in shards of about SHARD_DOCS documents (by a hash of their row
number, so that rows of one id are spread, too). No bin fits: the
permitted length that costs least per token it can still be given is opened. At the end each bin shrinks to the cheapest
permitted length that holds its contents. This is done once for each permitted length as the largest to be opened, and
the cheapest outcome stays; that optimises the lengths jointly.

Where documents have an order (of a mix), it is kept: windows of consecutive positions take the place of the shards, and
the bins of a window, full pieces included, are numbered in the order of the first position in them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import written

#: Permitted lengths and what a sequence of each costs: linear layers, and attention, which is quadratic.
COSTS = {c: c * (1 + c / 16384) for c in (512, 1024, 2048, 4096)}
SHARD_DOCS = 20_000
#: Consecutive positions that are packed together where documents have an order.
WINDOW_DOCS = 4096


def _one(lengths: list[int], costs: Mapping[int, float], most: int) -> tuple[float, list[int], list[int]]:
    """Cost, bin of each item and contents of each bin, if no bin over `most` is opened but for items that need it."""
    sizes = sorted(costs)
    left = sum(lengths)
    room: list[int] = []  # distinct sizes of free room, sorted; bins by free room
    bins_by: dict[int, list[int]] = {}
    used: list[int] = []
    where = [0] * len(lengths)

    def put(free: int, b: int) -> None:
        if free:
            if free not in bins_by:
                insort(room, free)
                bins_by[free] = []
            bins_by[free].append(b)

    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        at = bisect_left(room, n)
        if at < len(room):
            free = room[at]
            b = bins_by[free].pop()
            if not bins_by[free]:
                del bins_by[free], room[at]
        else:
            able = [c for c in sizes if c >= n]
            free = min([c for c in able if c <= most] or able[:1], key=lambda c: (costs[c] / min(c, left), c))
            b = len(used)
            used.append(0)
        used[b] += n
        left -= n
        where[i] = b
        put(free - n, b)
    return sum(min(costs[c] for c in sizes if c >= u) for u in used), where, used


def best_fit(lengths: list[int], costs: Mapping[int, float] = COSTS) -> tuple[list[int], list[int]]:
    """Bin of each item and length of each bin. Items must be from 1 to the largest permitted length."""
    sizes = sorted(costs)
    _, where, used = min((_one(lengths, costs, most) for most in sizes), key=lambda x: x[0])
    return where, [min((c for c in sizes if c >= u), key=lambda c: (costs[c], c)) for u in used]


def _pack(costs: Mapping[int, float], pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
    where, sizes = best_fit(pdf["length"].tolist(), costs)
    pdf["bin"] = where
    pdf["capacity"] = [sizes[b] for b in where]
    pdf["start"] = pdf.groupby("bin")["length"].cumsum() - pdf["length"]
    pdf["bin_id"] = "s" + pdf["shard"].astype(str) + "-" + pdf["bin"].astype(str)
    return pdf[["doc_id", "piece", "piece_start", "length", "bin_id", "capacity", "start"]]


def tokens(text: Column) -> Column:
    """The default length: words between white space, and one token that ends the document."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long") + 1


def pack(docs: DataFrame, length: Column | None = None, costs: Mapping[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row for each piece of a document: doc_id, piece (from 0), piece_start and length (tokens of the document),
    bin_id, capacity (the final length of the bin) and start (where in the bin the piece begins).

    All tokens of all documents are in exactly one piece. A null or empty text is one token long; a very long one gives as
    many full bins as it needs. Repeated rows and rows that share an id are packed each for itself; a null doc_id is packed
    like any other. A given length that is null or below 1 counts as 1. Extra columns play no part; an empty table gives an empty one. Rows are numbered and their tokens
    counted once, in a table in the shared folder, so that tasks which run again find the same numbers.
    """
    costs = dict(costs or COSTS)
    top = max(costs)
    n = F.col("n")
    given = (length if length is not None else tokens(F.col(text_col))).cast("long")
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(given, F.lit(1)).alias("n"))
    items, _ = written(counted.withColumn("row_id", F.monotonically_increasing_id()), "lengths")
    full = items.where(n >= top).select("doc_id", "row_id", F.explode(F.sequence(F.lit(0), F.floor(n / top).cast("int") - 1)).alias("piece"))
    full = full.select(
        "doc_id", "piece", (F.col("piece").cast("long") * top).alias("piece_start"), F.lit(top).cast("long").alias("length"),
        F.concat(F.lit("f"), F.col("row_id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("bin_id"),
        F.lit(top).alias("capacity"), F.lit(0).cast("long").alias("start"),
    )
    shards = max(1, -(-items.count() // shard_docs))
    rest = items.where(n % top > 0).select(
        "doc_id", F.floor(n / top).cast("int").alias("piece"), (n - n % top).alias("piece_start"), (n % top).alias("length"),
        F.pmod(F.xxhash64(F.lit(9), "row_id"), F.lit(shards)).alias("shard"),
    )
    ddl = "doc_id long, piece int, piece_start long, length long, bin_id string, capacity int, start long"
    return full.unionByName(rest.groupBy("shard").applyInPandas(partial(_pack, costs), ddl))


def _pack_window(costs: Mapping[int, float], pdf: pd.DataFrame) -> pd.DataFrame:
    top = max(costs)
    pdf = pdf.sort_values("position", kind="stable").reset_index(drop=True)
    count = (pdf["n"] + top - 1) // top
    pieces = pdf.loc[pdf.index.repeat(count)].reset_index(drop=True)
    pieces["piece"] = pieces.groupby("position").cumcount()
    pieces["piece_start"] = pieces["piece"] * top
    pieces["length"] = (pieces["n"] - pieces["piece_start"]).clip(upper=top)
    pieces["bin"], pieces["capacity"] = -1 - pieces.index, top
    rest = pieces.index[pieces["length"] < top]
    where, sizes = best_fit(pieces.loc[rest, "length"].tolist(), costs)
    pieces.loc[rest, "bin"] = where
    pieces.loc[rest, "capacity"] = [sizes[b] for b in where]
    pieces["start"] = pieces.groupby("bin")["length"].cumsum() - pieces["length"]
    pieces["nth"] = pd.factorize(pieces["bin"])[0]  # by first occurrence: pieces are in the order of position
    pieces["bin_id"] = "w" + pieces["window"].astype(str) + "-" + pieces["nth"].astype(str)
    return pieces[["doc_id", "piece", "piece_start", "length", "bin_id", "capacity", "start", "window", "nth", "position"]]


def pack_in_order(docs: DataFrame, costs: Mapping[int, float] | None = None, window_docs: int = WINDOW_DOCS) -> DataFrame:
    """docs: doc_id, n (tokens) and position, which is unique. As pack(), with window, nth (the bin's number in the window)
    and position: bins in the order of (window, nth) follow the positions, as near as window_docs of them allow. Null ids,
    repeated rows, very long documents and an empty table are as in pack(); extra columns play no part."""
    costs = dict(costs or COSTS)
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n").cast("long").alias("n"), F.col("position").cast("long").alias("position"), F.floor(F.col("position") / window_docs).alias("window"))
    ddl = "doc_id long, piece int, piece_start long, length long, bin_id string, capacity int, start long, window long, nth int, position long"
    return items.groupBy("window").applyInPandas(partial(_pack_window, costs), ddl)
