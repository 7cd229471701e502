"""Document fingerprints by Order MinHash, whose likeness falls with the edit distance and not with the set overlap alone.

A text's k-mers (K code points each) are numbered by occurrence, so that the pairs of k-mer and number are distinct. Under
each of DRAWS random orders the least TUPLE pairs are selected, put back in the order of the text, and the tuple of their
k-mers is hashed. Likeness is the share of draws with equal hashes.

A document, its edited text and the next document meet by a range partitioning along the descending ids: each task walks
its sorted rows and holds two of them. The few pairs across the borders of partitions are made in the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import batch, nonempty, small_batches, written

K, TUPLE, DRAWS = 8, 2, 64
#: Columns of a matrix of draws by k-mers that is made at once.
BLOCK = 2048
_M = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M(32))) * _M(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _M(32))) * _M(0xD6E8FEB86659FD93)
    return x ^ (x >> _M(32))


@cache
def _orders(draws: int) -> np.ndarray:
    """Of each order the odd factor by which it multiplies 32-bit numbers."""
    return np.random.default_rng(20).integers(0, 1 << 32, (draws, 1), dtype=np.uint32) | np.uint32(1)


def kmers(text: str, k: int = K) -> np.ndarray:
    """A 64-bit number for each k-mer, in the order of the text; a text shorter than k is one k-mer, an empty one has none."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(_M)
    if not len(points):
        return points
    k = min(k, len(points))
    whole, width = None, 0  # polynomials of windows of the binary parts of k, put together
    part, size, factor = points, 1, 0x9E3779B97F4A7C15
    while True:
        if k & size:
            whole = part if whole is None else whole[: len(whole) - size] * _M(factor) + part[width:]
            width += size
        if width == k:
            return _mix(whole + _M(k))
        part = part[:-size] * _M(factor) + part[size:]
        size, factor = size * 2, factor * factor % (1 << 64)


def occurrences(x: np.ndarray) -> np.ndarray:
    """How often each number was there before. The low bits of the sorted keys are positions; the others tell numbers apart."""
    n = len(x)
    low = _M((1 << n.bit_length()) - 1)
    keys = np.sort((x & ~low) | np.arange(n, dtype=_M))
    high = keys | low
    again = np.concatenate([[False], high[1:] == high[:-1]])
    out, at = np.zeros(n, _M), np.arange(n)
    if again.any():
        out[(keys & low).astype(np.int64)] = at - np.maximum.accumulate(np.where(again, 0, at))
    return out


def signature(text: str, k: int = K, size: int = TUPLE, draws: int = DRAWS) -> np.ndarray:
    """One 32-bit number for each draw. Texts with fewer pairs than a tuple has give what pairs they have."""
    grams = kmers(text, k)
    pairs = (_mix(grams + occurrences(grams) * _M(0xA0761D6478BD642F)) >> _M(32)).astype(np.uint32)
    factor, lines = _orders(draws), np.arange(draws)
    values, places = [], []  # the least pairs of each block, as columns
    for start in range(0, len(pairs), BLOCK):
        drawn = pairs[None, start : start + BLOCK] * factor
        for nth in range(min(size, drawn.shape[1])):
            if nth:
                drawn[lines, least] = np.uint32(0xFFFFFFFF)
            least = drawn.argmin(1)
            values.append(drawn[lines, least])
            places.append(start + least)
    at = np.stack(places, 1) if places else np.zeros((draws, 0), np.int64)
    if len(places) > size:  # blocks come in the order of the text, so a stable sort prefers the earlier pair
        at = np.take_along_axis(at, np.argsort(np.stack(values, 1), axis=1, kind="stable")[:, :size], 1)
    at.sort(axis=1)
    out = np.full(draws, at.shape[1], _M)
    for column in at.T:
        out = _mix(out * _M(0x9E3779B97F4A7C15) + grams[column])
    return (out >> _M(32)).astype(np.uint32)


def octets(s: np.ndarray) -> bytes:
    return s.astype(">u4").tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as much of the beginning of the following text, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
EDGE = pa.schema([*OUT, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])
DDL = "doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(doc_id: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    changed = edited(text, following)
    new = own if changed == text else signature(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode()).digest(), octets(own), octets(new), likeness(own, new), likeness(own, other)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows each with the one after it; the first and the last row as edges, with their texts."""
    part, last = TaskContext.get().partitionId(), None
    none = (None,) * (len(OUT) - 1)
    for b in nonempty(batches):
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            own = last[2] if last is not None and last[1] == text else signature(text)
            rows.append((doc_id, *none, part, "head", text) if last is None else (*_compared(*last, text, own), None, None, None))
            last = doc_id, text, own
        yield batch(EDGE, *zip(*rows, strict=True))
    if last is not None:
        yield batch(EDGE, *zip((last[0], *none, part, "tail", last[1]), strict=True))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in nonempty(batches):
        rows = [_compared(d, t, signature(t), f, signature(f)) for d, t, f in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield batch(OUT, *zip(*rows, strict=True))


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """docs: doc_id, text. One row for each: doc_id, n_chars (code points), edited_sha256, fingerprint and edited_fingerprint
    (8 hex digits for each draw), near_edited and near_next (likeness of its fingerprint to those of the edited text and of
    the next document).

    Next is the document of the next smaller id, after the last the first; of rows that share an id the order is that of a
    hash of the text, and rows without an id come last. A lone document is followed by itself. Null and empty texts are
    empty, and alike. Repeated rows give a row each; very long texts are taken whole; extra columns, whatever their names,
    play no part; an empty table gives an empty one. partitions: into how many ranges ids are cut (spark.sql.shuffle.partitions
    where not given); rows of one id, and copies of one row, may be cut, too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("nth"))
    order = F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("nth")
    ranged = rows.repartitionByRange(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    walked, _ = written(ranged.select("doc_id", "text").mapInArrow(_walk, f"{DDL}, part int, edge string, text string"), "fingerprints")
    heads, tails = (walked.where(F.col("edge") == e).select("part", "doc_id", "text") for e in ("head", "tail"))
    parts = sorted(r[0] for r in heads.select("part").collect())  # one number for each partition that has rows
    after = spark.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1])], "part int, following int")
    pairs = tails.join(F.broadcast(after), "part").join(heads.select(F.col("part").alias("following"), F.col("text").alias("next_text")), "following")
    every = walked.where("edge IS NULL").drop("part", "edge", "text").unionByName(pairs.select("doc_id", "text", "next_text").mapInArrow(_across, DDL))
    return every.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})  # the table has half the size without
