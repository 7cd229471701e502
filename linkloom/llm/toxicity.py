"""Toxicity by two class-conditional Kneser-Ney models over words.

Each class (toxic, ordinary) has a Kneser-Ney continuation distribution: in how many different contexts (words before it)
the class has a word, less an absolute discount that is estimated from how many words have one and two contexts; what the
discount frees goes to a distribution that both classes share, in how many documents of the corpus the word occurs.

Documents are compared by length-normalised differences of the two log-likelihoods: the mean over all words, and the
means of what strong words add beyond TAIL on either side, since a few of them in a long text would drown in the small
differences of all others. There a word counts with its difference less ERRORS standard errors (one over the root of its
contexts), so that rare expressions, whose difference is mostly that of the discount and the backoff, say little. A
logistic curve on these, fitted on labelled documents that the counts left out, makes a probability.

Words are keyed by 63-bit hashes and the model has every word that a labelled document has, however many there are. The
commonest of them, up to MODEL_WORDS, are broadcast; the words of documents that are not among these meet the rest of the
model by a join. Class counts come from all labelled documents that may be learned from but those that fit the curve, of
which there are about PER_CLASS of either class, at most one in CURVE, chosen by hash. The shared counts come from all
documents that may be learned from, labelled or not. Probabilities given the word before (the bigram level) were measured
and left out; see README.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import WordIds, batch, labelled, nonempty, share, small_batches, texts, written

#: Documents of either class that fit the curve, at most about, and at most one labelled document in so many.
PER_CLASS, CURVE = 2_500, 4
#: Differences of log-likelihoods up to this count in the mean only.
TAIL = 2.0
#: What the strength of a word loses first, in standard errors of its count.
ERRORS = 2.0
THRESHOLD = 0.7
#: Words of the model that are broadcast (16 bytes each); the rest is joined.
MODEL_WORDS = 2_000_000
#: Labels to count are broadcast up to this number (12 bytes each), else shuffled with the texts.
BROADCAST_LABELS = 1_000_000
#: Partial counts of a task are sent on when they hold so many words.
FLUSH = 4_000_000

_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: The history of a text's first word.
BEGIN = 0


def words(text: str, ids: WordIds) -> np.ndarray:
    """Hashes of the lower-cased words; digits and signs part words."""
    w = text.lower().encode("utf-8", "replace").translate(_TABLE).split()
    return np.fromiter(map(ids.__getitem__, w), np.int64, len(w))


def _ids() -> WordIds:
    return WordIds(63, 17)


@dataclass
class Model:
    """For each broadcast word (sorted) the log-likelihood in the toxic class less that in the ordinary one, and the same
    less the standard errors; `unknown` is the difference of a word that no labelled document has. rest: word, difference,
    strength of the words that are not broadcast, if there are any. The curve is on inputs()."""

    word: np.ndarray
    difference: np.ndarray
    strength: np.ndarray
    unknown: float = 0.0
    rest: DataFrame | None = None
    curve: tuple[float, ...] = field(default=(0.0, 0.0, -1.0, 0.0, 1.0))

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, bool]:
        """What tasks need."""
        return self.word, self.difference, self.strength, self.unknown, self.rest is not None


_COUNTS = pa.schema([("y", pa.int32()), ("word", pa.int64()), ("before", pa.int64()), ("n", pa.int64())])
#: In place of a class: the row counts the documents that have the word.
DOCUMENTS = -1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """y (null: no label) and text to distinct pairs of words by class, and numbers of documents by word."""
    ids = _ids()
    seen: list[np.ndarray] = []
    pairs: dict[int, list[np.ndarray]] = {0: [], 1: []}

    def flush():
        word, n = np.unique(np.concatenate(seen), return_counts=True)
        yield batch(_COUNTS, np.full(len(word), DOCUMENTS), word, np.zeros(len(word), np.int64), n)
        for y, held in pairs.items():
            if held:
                both = np.concatenate(held, axis=1)
                both = both[:, np.lexsort(both)]
                both = both[:, np.r_[True, (both[:, 1:] != both[:, :-1]).any(axis=0)]]
                yield batch(_COUNTS, np.full(both.shape[1], y), both[1], both[0], np.ones(both.shape[1], np.int64))

    for b in nonempty(batches):
        for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = words(text, ids)
            if w.size:
                seen.append(np.unique(w))
                if y is not None:
                    pairs[y].append(np.stack([np.r_[BEGIN, w[:-1]], w]))
        if sum(map(len, seen)) + sum(p.shape[1] for held in pairs.values() for p in held) > FLUSH:
            yield from flush()
            seen, pairs = [], {0: [], 1: []}
    if seen:
        yield from flush()


def counted(rows: DataFrame) -> DataFrame:
    """rows: y and text. For each word: n (documents that have it), k0 and k1 (its contexts in either class)."""
    each = rows.select("y", "text").mapInArrow(_count, "y int, word long, before long, n long").groupBy("y", "word", "before").agg(F.sum("n").alias("n"))
    contexts = lambda y: F.count_if(F.col("y") == y).alias(f"k{y}")
    return each.groupBy("word").agg(F.sum(F.when(F.col("y") == DOCUMENTS, F.col("n"))).alias("n"), contexts(0), contexts(1))


def likelihoods(totals: dict) -> tuple[Column, Column, float]:
    """Columns of difference and strength for a table as from counted(), and the difference of unknown words, given its
    totals: n, and for either class y k{y} (contexts), types{y} (words), ones{y} and twos{y} (words with so many contexts)."""
    p, backoff = [], []
    for y in (0, 1):
        k, ones, twos = totals[f"k{y}"], totals[f"ones{y}"], totals[f"twos{y}"]
        discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
        backoff.append(discount * totals[f"types{y}"] / k if k else 1.0)
        own = F.greatest(F.col(f"k{y}") - F.lit(discount), F.lit(0.0)) / F.lit(float(max(1, k)))
        p.append(own + F.lit(backoff[y]) * F.col("n") / F.lit(float(max(1, totals["n"]))))
    difference = F.log(p[1]) - F.log(p[0])
    contexts = F.when(difference > 0, F.col("k1")).otherwise(F.col("k0"))
    strength = F.signum(difference) * F.greatest(F.abs(difference) - F.lit(ERRORS) / F.sqrt(F.greatest(contexts, F.lit(1))), F.lit(0.0))
    return difference, strength, float(np.log(backoff[1]) - np.log(backoff[0]))


_MEASURED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_words", pa.int64()), ("mean", pa.float64()), ("above", pa.float64()), ("below", pa.float64()), ("text_key", pa.binary()), ("others", pa.list_(pa.int64()))])
_MEASURED_DDL = "doc_id long, held_out boolean, n_words long, mean double, above double, below double, text_key binary, others array<long>"


def _measure(model_of, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the words of each text. Words that are not broadcast count as unknown, or, if there is a rest, are listed."""
    ids = _ids()
    word, difference, strength, unknown, listed = model_of.value
    for b in nonempty(batches):
        texts_of = b.column(2).to_pylist()
        got = [words(t, ids) for t in texts_of]
        ends = np.cumsum([len(w) for w in got])
        w = np.concatenate(got)
        at = np.minimum(np.searchsorted(word, w), max(0, len(word) - 1))
        known = word[at] == w if len(word) else np.zeros(len(w), bool)
        d = np.where(known, difference[at].astype(float), 0.0 if listed else unknown) if len(word) else np.full(len(w), 0.0 if listed else unknown)
        s = np.where(known, strength[at].astype(float), 0.0) if len(word) else np.zeros(len(w))
        sums = [np.diff(np.r_[0.0, np.r_[0.0, np.cumsum(x)][ends]]) for x in (d, np.maximum(s - TAIL, 0), np.maximum(-s - TAIL, 0))]
        keys = [xxhash.xxh3_128_digest(t.encode("utf-8", "replace")) if listed else b"" for t in texts_of]
        others = [x[~known[e - len(x) : e]] if listed else x[:0] for x, e in zip(got, ends, strict=True)]
        yield batch(_MEASURED, b.column(0), b.column(1), [len(x) for x in got], *sums, keys, others)


def _measured(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_words, and the means of the differences and of their excess over TAIL on either side."""
    table = rows.sparkSession.sparkContext.broadcast(model.table())
    found = rows.select("doc_id", "held_out", "text").mapInArrow(partial(_measure, table), _MEASURED_DDL)
    if model.rest is not None:
        found, _ = written(found, "measured")
        each = found.groupBy("text_key").agg(F.first("others").alias("others")).select("text_key", F.explode("others").alias("word"))
        met = each.groupBy("text_key", "word").agg(F.count("*").alias("n")).join(model.rest, "word", "left")
        beyond = lambda sign: F.sum(F.col("n") * F.greatest(sign * F.coalesce("strength", F.lit(0.0)) - TAIL, F.lit(0.0)))
        more = met.groupBy("text_key").agg(F.sum(F.col("n") * F.coalesce("difference", F.lit(model.unknown))).alias("m"), beyond(1).alias("a"), beyond(-1).alias("b"))
        more, _ = written(more, "rest")
        plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0.0))).alias(x)
        found = found.join(more, "text_key", "left").select("doc_id", "held_out", "n_words", plus("mean", "m"), plus("above", "a"), plus("below", "b"))
    of = lambda x: (F.col(x) / F.greatest("n_words", F.lit(1))).alias(x)
    return found.select("doc_id", "held_out", of("mean"), of("above"), of("below"), "n_words")


def inputs(mean, above, below, n, log1p=np.log1p) -> list:
    """What the curve weighs, besides a constant; on arrays, or with F.log1p on columns."""
    return [mean, below, above * n**0.5, log1p(above * n)]


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's method, with a small ridge."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, c = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        g = z.T @ (weight * (p - y)) + ridge * c
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(c)), g)
        c -= step
        if np.abs(step).max() < 1e-8:
            break
    return c / scale


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """From all documents that may be learned from (shared counts) and all labelled ones of them (class counts), but for
    about per_class of either class, one in CURVE at most, that fit the curve."""
    small_batches(docs.sparkSession)
    rows = texts(docs, id_col, text_col).where(may_learn)
    known = labelled(labels, "toxic", may_learn)
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rates = {y: min(1 / CURVE, per_class / n) for y, n in sizes.items()}
    rate = F.when(F.col("y") == 1, F.lit(rates.get(1, 0.0))).otherwise(F.lit(rates.get(0, 0.0)))
    for_curve = share(F.col("doc_id"), 23) < rate
    sample = F.broadcast(known.where(for_curve))  # about 2 * per_class rows of 12 bytes
    others = known.where(~for_curve).hint("broadcast" if sum(sizes.values()) <= BROADCAST_LABELS else "shuffle_hash")

    table, _ = written(counted(rows.join(others, "doc_id", "left")), "words")
    column = lambda y: F.col(f"k{y}")
    totals = table.agg(F.sum("n").alias("n"), *(f for y in (0, 1) for f in (F.sum(column(y)).alias(f"k{y}"), F.count_if(column(y) > 0).alias(f"types{y}"), F.count_if(column(y) == 1).alias(f"ones{y}"), F.count_if(column(y) == 2).alias(f"twos{y}")))).first()
    difference, strength, unknown = likelihoods({k: v or 0 for k, v in totals.asDict().items()})
    model = table.where((F.col("k0") > 0) | (F.col("k1") > 0)).select("word", difference.cast("float").alias("difference"), strength.cast("float").alias("strength"), F.floor(F.log2("n")).cast("int").alias("size"))

    # the commonest words, by powers of two, as far as they may be broadcast
    least, room = 64, MODEL_WORDS
    for r in model.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():  # 64 rows at most
        if r["n"] > room:
            break
        least, room = r["size"], room - r["n"]
    else:
        least = 0
    head = model.where(F.col("size") >= least).select("word", "difference", "strength").orderBy("word").toArrow()  # MODEL_WORDS rows at most
    array = lambda c: head.column(c).to_numpy()
    made = Model(array("word"), array("difference"), array("strength"), unknown, model.where(F.col("size") < least).select("word", "difference", "strength") if least else None)

    fit = rows.withColumn("held_out", F.lit(False)).join(sample, "doc_id", "left_semi")
    got = _measured(fit, made).join(sample, "doc_id").toArrow()  # about 2 * per_class rows
    y = got.column("y").to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        x = inputs(*(got.column(c).to_numpy().astype(float) for c in ("mean", "above", "below", "n_words")))
        weight = np.where(y == 1, 1 / rates[1], 1 / rates[0])
        made.curve = tuple(fit_curve(np.stack([np.ones(len(y)), *x], axis=1), y, weight * len(y) / weight.sum()))
    return made


def score(docs: DataFrame, model: Model, held_out: Column | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from the threshold on), mean, above, below, n_words for each row of docs.

    A null, empty or wordless text has no evidence and gets the curve's value there; a very long text is scored whole, in
    time linear in its words. Repeated rows give repeated rows; labels for ids that are missing are ignored; without
    labels of both classes the curve keeps its default. Extra columns of docs play no part. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = texts(docs, id_col, text_col).withColumn("held_out", F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False)))
    z = F.lit(float(model.curve[0]))
    for c, x in zip(model.curve[1:], inputs(F.col("mean"), F.col("above"), F.col("below"), F.col("n_words"), F.log1p), strict=True):
        z = z + float(c) * x
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))
    return _measured(rows, model).withColumn("score", p).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "mean", "above", "below", "n_words")
