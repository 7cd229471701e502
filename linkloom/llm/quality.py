"""Quality by a factorisation machine over hashed words, statistics of structure and metadata.

y = w0 + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j. The pairs are never listed: for each factor they are half
of (sum of v_i x_i) squared less the sum of (v_i x_i) squared, so a document costs time linear in its features. Words
are hashed to 2**BITS features, with the logarithm of their counts, scaled to length one; statistics and metadata (the
text's length) are cut into bins, one feature for each bin, so that they interact with words and with one another.

The machine is fitted by AdaGrad on the driver, on about PER_CLASS labelled documents of either class, chosen by hash; on
fewer, chosen likewise, if these have more than FIT_FEATURES features in all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import WordIds, batch, labelled_sample, nonempty, share, small_batches, texts, utf8, written

BITS, FACTORS = 16, 8
PER_CLASS = 4_000
#: Features of the documents that the machine is fitted on, about (8 bytes each).
FIT_FEATURES = 8_000_000
EPOCHS, BATCH, RATE, RIDGE = 6, 128, 0.08, 1e-5
THRESHOLD = 0.3
BINS = 16
SEED = 29

_KIND = np.zeros((256, 6))
for _i, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), [10], [124], [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;'\"-|"])):
    _KIND[list(_chars), _i] = 1
STATISTICS = ("upper", "lower", "digits", "lines", "bars", "signs", "distinct words", "distinct lines", "word length", "commonest word", "length")


def statistics(text: bytes, words: list[bytes], counts: Counter) -> np.ndarray:
    """Of structure, and the length as metadata; each from 0 to 1."""
    size, n = max(1, len(text)), max(1, len(words))
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _KIND / size
    lines = text.split(b"\n")
    kinds[3:5] *= 10
    rest = (len(counts) / n, len(set(lines)) / len(lines), size / n / 40, max(counts.values(), default=0) / n, np.log1p(len(text)) / 16)
    return np.minimum(np.r_[np.sqrt(kinds), rest], 1.0)


def features(text: bytes, ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: words first, then a bin for each statistic."""
    words = text.lower().split()
    counts = Counter(words)
    at = np.fromiter(map(ids.__getitem__, counts), np.int64, len(counts))
    x = np.log1p(np.fromiter(counts.values(), float, len(counts)))
    if at.size:
        x /= np.sqrt((x * x).sum())
    s = statistics(text, words, counts)
    bins = (1 << BITS) + np.arange(len(s)) * BINS + np.minimum((s * BINS).astype(np.int64), BINS - 1)
    return np.r_[at, bins], np.r_[x, np.full(len(s), 0.5)]


SIZE = (1 << BITS) + BINS * len(STATISTICS)


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, at: list[np.ndarray], x: list[np.ndarray]) -> np.ndarray:
        """Of several documents, each with at least one feature, in time linear in their features."""
        start = np.cumsum([0, *map(len, at[:-1])])
        i, z = np.concatenate(at), np.concatenate(x)
        vx = self.v[i] * z[:, None]
        pairs = np.add.reduceat(vx, start) ** 2 - np.add.reduceat(vx * vx, start)
        return self.bias + np.add.reduceat(self.w[i] * z, start) + 0.5 * pairs.sum(axis=1)


def _ids() -> WordIds:
    return WordIds(BITS, SEED)


_FEATURES = pa.schema([("y", pa.int32()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("raw", pa.float64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = _ids()
    for b in nonempty(batches):
        got = [features(t, ids) for t in utf8(b.column(1))]
        yield batch(_FEATURES, b.column(0), [a.astype(np.int32) for a, _ in got], [x.astype(np.float32) for _, x in got])


def _score(machine_of, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, machine = _ids(), machine_of.value
    for b in nonempty(batches):
        yield batch(_SCORES, b.column(0), b.column(1), machine.raw(*map(list, zip(*(features(t, ids) for t in utf8(b.column(2))), strict=True))))


def fit(y: np.ndarray, at: list[np.ndarray], x: list[np.ndarray], weight: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Machine:
    """AdaGrad on the logistic loss, in small batches."""
    rng = np.random.default_rng(seed)
    bias, w, v = 0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, FACTORS))
    gw, gv, gb = np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            rows = order[i : i + BATCH]
            sizes = np.array([len(at[r]) for r in rows])
            start = np.r_[0, np.cumsum(sizes)[:-1]]
            a, z = np.concatenate([at[r] for r in rows]), np.concatenate([x[r] for r in rows]).astype(float)
            vx = v[a] * z[:, None]
            sums = np.add.reduceat(vx, start)
            raw = bias + np.add.reduceat(w[a] * z, start) + 0.5 * (sums**2 - np.add.reduceat(vx * vx, start)).sum(axis=1)
            g = weight[rows] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / len(rows)
            each = np.repeat(g, sizes) * z
            gradient = each[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            used, where = np.unique(a, return_inverse=True)
            dw = np.bincount(where, each, len(used)) + RIDGE * w[used]
            dv = np.stack([np.bincount(where, gradient[:, f], len(used)) for f in range(FACTORS)], axis=1) + RIDGE * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += g.sum() ** 2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE / 4 * dv / np.sqrt(gv[used])
            bias -= RATE * g.sum() / np.sqrt(gb)
    return Machine(float(bias), w.astype(np.float32), v.astype(np.float32))


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """From the labelled documents of the sample, weighted back to how common their class is. Without any: a machine that says 0.5."""
    small_batches(docs.sparkSession)
    sample, rates = labelled_sample(labels, "quality", may_learn, per_class)
    rows = texts(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")  # about 2 * per_class rows of 12 bytes
    made, _ = written(rows.select("y", "text").mapInArrow(_extract, "y int, at array<int>, x array<float>"), "features")
    size = made.agg(F.sum(F.size("at")).alias("n")).first()["n"] or 0
    got = (made if size <= FIT_FEATURES else made.where(share(F.xxhash64("at")) < FIT_FEATURES / size)).toArrow()
    y = got.column("y").to_numpy().astype(float)
    if not len(y):
        return Machine(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, FACTORS), np.float32))
    weight = np.where(y == 1, 1 / rates.get(1, 1), 1 / rates.get(0, 1))
    split = lambda c: np.split(c.combine_chunks().flatten().to_numpy(), c.combine_chunks().offsets.to_numpy()[1:-1])
    at, x = split(got.column("at")), split(got.column("x"))
    order = np.lexsort(([float(v.sum()) for v in x], [int(a.sum()) for a in at], y))  # the same order, however rows arrived
    return fit(y[order], [at[i] for i in order], [x[i] for i in order], (weight / weight.mean())[order])


def score(docs: DataFrame, machine: Machine, held_out: Column | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from the threshold on) for each row of docs.

    A null or empty text is scored by its statistics alone; a very long one whole. Repeated rows give repeated rows; labels for ids that are
    missing are ignored. Extra columns of docs play no part. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = texts(docs, id_col, text_col).select("doc_id", (F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("held_out"), "text")
    raw = rows.mapInArrow(partial(_score, docs.sparkSession.sparkContext.broadcast(machine)), "doc_id long, held_out boolean, raw double")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("raw")))))
    return raw.withColumn("score", p).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
