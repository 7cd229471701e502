"""Connected components of a link table by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import Scratch, batch, delete, nonempty, written

#: Links that a task holds at once to contract them.
HELD = 2_000_000
#: Nodes with more links than this, or than one in so many of all, are hubs: HUBS at most, so they may be broadcast.
DEGREE, HUBS = 256, 4096

_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that links join to a smaller one, with the smallest it is joined to."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            moved = root != np.arange(len(nodes))
            return nodes[moved], nodes[root[moved]]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in nonempty(batches):
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) > HELD:
            held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
            if len(held[0][0]) > HELD // 2:
                yield batch(_LINKS, *held.pop())
    if held:
        yield batch(_LINKS, *stars(*map(np.concatenate, zip(*held, strict=True))))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node next to it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("degree"))
    hubs = near.where(F.col("degree") > max(DEGREE, 2 * n // HUBS)).select("u", "m").toArrow()  # HUBS rows at most
    if hubs.num_rows:  # no task gets all links of a hub: those are joined where they are
        known = F.broadcast(edges.sparkSession.createDataFrame(hubs))
        met = both.join(known, "u").unionByName(both.join(known, "u", "left_anti").join(near.select("u", "m"), "u"))
    else:
        met = both.join(near.select("u", "m"), "u")
    return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; in edges, a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, tables: Scratch | None = None) -> DataFrame:
    """links: columns a and b (long), in any direction, repeats and loops allowed; read once. tables: takes the result's table.

    Returns node and root for each node of a component of two or more nodes, but for the root itself;
    root is the smallest node of the component. An empty table of links gives an empty table.
    """
    spark = links.sparkSession
    local = links.where("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long")  # links become stars in each task first
    edges, path = written(local.distinct(), "links")
    state = _state(edges)
    while state[0]:
        after, new = written(_small_star(_large_star(edges, state[0])), "stars")
        delete(spark, path)
        before, state, edges, path = state, _state(after), after, new
        if before == state:
            break
    if tables is not None:
        tables.paths.append((spark, path))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
