"""Exact top-k inner products by MaxScore, over shards of integer vectors.

A query's terms are the dimensions in which it is not zero; a term's posting list in a shard holds the vectors to which it
adds something positive, and its bound is the most it adds to any of them. With terms by falling bound, those at the end
whose bounds together stay below the lowest score that still counts are not essential: a vector on no essential list can't
compete. The essential lists are traversed, the other terms are probed while a vector's partial score and the bounds that
are left reach that lowest score, and the shards' best are merged.

A task holds one shard after another and hands the best found so far on, so that later shards have a score to beat from
the start, and a task gives k rows a query however many shards it had. Queries are dealt into blocks of about QUERY_BYTES,
each sent to all tasks by a scan of its own, so the driver and tasks hold the queries of one block at a time. Where there
are several, each block's best are written before the next begins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm.common import batch, nonempty, written

#: Size of a block of queries.
QUERY_BYTES = 32 << 20
#: Vectors that one shard holds at most; a task may hold several shards, one after another.
SHARD = 8192
#: Queries whose best leave a task in one batch.
QUERIES_OUT = 4096
#: Terms whose contributions are added between two prunings.
STEP = 8

_VECTORS = "vec_id long, v array<long>"


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and v = floor(scale * x) of each component; no vectors that are null, hold null or non-finite components, or have a null id."""
    x = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    return rows.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | c.isin(math.inf, -math.inf))).select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


#: Sums of absolute products up to here fit a long, as do all that are made on the way.
SAFE = 2.0**62


def matrix(column: pa.Array, least: int = 0) -> np.ndarray:
    """Vectors as rows, filled with zeros to one length (a missing component adds nothing)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    width = max([least, *sizes.tolist()]) if len(sizes) else least
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Shard:
    """Vectors with their posting lists by term and sign, and the bounds of these."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.columns = np.ascontiguousarray(self.x.T)
        self.high, self.low = self.columns.max(axis=1), self.columns.min(axis=1)
        self.lists: dict[tuple[int, bool], np.ndarray] = {}
        self.most = np.maximum(self.high.astype(float), -self.low.astype(float))

    def postings(self, term: int, positive: bool) -> np.ndarray:
        key = term, positive
        if key not in self.lists:
            self.lists[key] = (self.columns[term] > 0) if positive else (self.columns[term] < 0)
        return self.lists[key]

    def top(self, query_id: int, q: np.ndarray, k: int, beat: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own: highest score first, then smaller id. Those below the
        score to beat may be left out."""
        n = len(self.ids)
        width = min(len(q), len(self.columns))
        if np.abs(q[:width].astype(float)) @ self.most[:width] >= SAFE:
            return self._exact(query_id, q[:width], k)
        terms = np.flatnonzero(q[:width])
        bounds = np.maximum(0, np.maximum(q[terms] * self.high[terms], q[terms] * self.low[terms]))
        order = np.argsort(-bounds, kind="stable")
        terms, bounds = terms[order], bounds[order]
        rest = np.r_[np.cumsum(bounds[::-1])[::-1], 0]  # bounds of the terms from here on
        own = (self.ids == query_id) if self.ids[0] <= query_id <= self.ids[-1] else np.zeros(n, bool)
        if beat is not None and rest[0] < beat:
            return self.ids[:0], np.zeros(0, np.int64)
        if n - int(own.sum()) <= k or not terms.size:
            return self._best(np.flatnonzero(~own), q[:width], width, k)
        # some rows that are high in the first terms set the score to beat
        first = terms[: 2 * STEP]
        guess = q[first] @ self.columns[first]
        guess[own] = np.iinfo(np.int64).min
        seeds = np.argpartition(guess, n - k)[n - k :]
        lowest = int((self.x[seeds][:, :width] @ q[:width]).min())
        lowest = lowest if beat is None else max(lowest, beat)
        # essential: the terms before the first at which all that follow stay below the lowest score
        essential = int(np.argmax(rest < lowest)) if (rest < lowest).any() else len(terms)
        if essential < len(terms) or lowest > 0:
            some = np.zeros(n, bool)
            for t in terms[:essential]:
                some |= self.postings(int(t), bool(q[t] > 0))
            at = np.flatnonzero(some & ~own)
        else:  # nothing is needed to reach it, so all rows compete
            at = np.flatnonzero(~own)
        score = np.zeros(len(at), np.int64)
        for i in range(0, len(terms), STEP):
            part = terms[i : i + STEP]
            score += q[part] @ (self.columns[np.ix_(part, at)] if len(at) < n else self.columns[part])
            alive = score + rest[min(i + STEP, len(terms))] >= lowest
            if not alive.all():
                at, score = at[alive], score[alive]
        return self._cut(at, score, k)

    def _best(self, at: np.ndarray, q: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self._cut(at, self.x[at][:, :width] @ q, k)

    def _exact(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a part of a product might not fit a long: by integers of any size, over all rows."""
        at = np.flatnonzero(self.ids != query_id)
        score = self.x[at][:, : len(q)].astype(object) @ q.astype(object)
        best = sorted(range(len(at)), key=lambda i: (-score[i], self.ids[at[i]]))[:k]
        if any(not -(1 << 63) <= score[i] < 1 << 63 for i in best):
            raise OverflowError("one of the highest scores does not fit a long")
        return self.ids[at[best]], np.array([score[i] for i in best], np.int64)

    def _cut(self, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at][order], score[order]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(queries_of, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, queries = queries_of.value
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def run():
        width = max(1, *(x.shape[1] for _, x in held))
        shard = Shard(np.concatenate([i for i, _ in held]), np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for _, x in held]))
        for at, (i, q) in enumerate(zip(ids, queries, strict=True)):
            had, scores = best[at]
            more, found = shard.top(int(i), q, k, int(scores[-1]) if len(had) >= k else None)
            if len(more):
                v, s = np.r_[had, more], np.r_[scores, found]
                order = np.lexsort((v, -s))[:k]
                best[at] = v[order], s[order]

    for b in nonempty(batches):
        held.append((b.column(0).to_numpy(), matrix(b.column(1))))
        if sum(len(i) for i, _ in held) >= SHARD:
            run()
            held = []
    if held:
        run()
    for at in range(0, len(ids), QUERIES_OUT):
        part = best[at : at + QUERIES_OUT]
        yield batch(_FOUND, np.repeat(ids[at : at + QUERIES_OUT], [len(v) for v, _ in part]), np.concatenate([v for v, _ in part]), np.concatenate([s for _, s in part]))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, query_block: int | None = None) -> DataFrame:
    """vectors: vec_id and v, as from integer_vectors. For each query its k best candidates, every row but those of its own
    id: query_id, rank (from 1), vec_id, score. Equal scores go to the smaller vec_id. query_block: queries sent to all tasks
    at once; None: as many as QUERY_BYTES hold.

    Vectors of different lengths meet as if filled with zeros. Rows that repeat an id each count as candidates; as a
    query, rows that repeat id and vector count once, and with other vectors they compete for one list. Products that may
    not fit a long are made of integers of any size; a score among the highest that does not fit raises an error. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    queries = vectors.where(is_query)
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    blocks = max(1, math.ceil(size["n"] / (query_block or max(1, QUERY_BYTES // (8 * max(1, size["width"] or 0))))))
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    parts = None
    for i in range(blocks):
        own = queries.where(block == i).distinct().toArrow()  # about one block
        if not own.num_rows:
            continue
        column = own.column("v").combine_chunks()
        sent = spark.sparkContext.broadcast((own.column("vec_id").to_numpy(), matrix(column, 1)))
        found = vectors.mapInArrow(partial(_search, sent, k), "query_id long, vec_id long, score long")
        if blocks > 1:
            found, _ = written(best(found).drop("rank"), "block")
        parts = found if parts is None else parts.union(found)
    if parts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best(parts).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
