"""Language by rank-order profiles: a document's most frequent n-grams against those of each language, by out-of-place distance.

N-grams are one to three characters of lower-cased words, spaces around words included. A profile holds the PROFILE most
frequent ones in order. An n-gram is as far out of place as its ranks differ, or PROFILE if the language lacks it.
Languages' counts are taken over all documents that may be learned from. A language's profile takes PROFILE numbers, on
the driver and in in tasks, LANGUAGES of them to a list.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm.common import batch, nonempty, small_batches

PROFILE = 300
#: Characters that are counted at once: bounds memory for very long texts.
PIECE = 1 << 20
#: Partial counts of a task are sent on when they have so many n-grams.
FLUSH = 1 << 20
#: The most frequent n-grams of a language are first sought in so many parts.
PARTS = 16
#: Languages in one list (12 bytes for each n-gram).
LANGUAGES = 4096
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "L"]] = True
    return out


def _spaced(text: str) -> np.ndarray | None:
    """Code points of the lower-cased words with a space around each; None if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _letters()[codes]
    if not is_letter.any():
        return None
    x = np.full(len(codes) + 2, 32, np.uint64)
    x[1:-1][is_letter] = codes[is_letter]
    return x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]]


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(counts, at)


def ngrams(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, 21 bits for each character, and their counts."""
    parts = []
    for at in range(0, len(x), PIECE):
        y = x[at : at + PIECE + 2]
        one, two = y[:PIECE], y[: PIECE + 1]
        pairs = (two[:-1] << np.uint64(21)) | two[1:]
        triples = ((y[:-2] << np.uint64(42)) | (y[1:-1] << np.uint64(21)) | y[2:])[y[1:-1] != 32] if len(y) > 2 else y[:0]
        parts.append(np.unique(np.concatenate([one[one != 32], pairs, triples]), return_counts=True))
    return parts[0] if len(parts) == 1 else merge(*map(np.concatenate, zip(*parts, strict=True)))


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order, ties by n-gram."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:size]


_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            k, n = merge(*map(np.concatenate, zip(*parts, strict=True)))
            yield batch(_COUNTS, [lang] * len(k), k.view(np.int64), n)

    for b in nonempty(batches):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if (x := _spaced(text)) is not None:
                k, n = ngrams(x)
                held.setdefault(lang, []).append((k, n.astype(np.int64)))
                size += len(k)
        if size > FLUSH:
            for lang, parts in held.items():
                held[lang] = [merge(*map(np.concatenate, zip(*parts, strict=True)))]
            if (size := sum(len(k) for parts in held.values() for k, _ in parts)) > FLUSH // 2:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def learn(docs: DataFrame, may_learn: Column, size: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Profiles by language, from every document that may be learned from and has a language."""
    small_batches(docs.sparkSession)
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    part = F.pmod(F.xxhash64("gram"), F.lit(PARTS))
    best = F.row_number().over(Window.partitionBy("lang", part).orderBy(F.desc("n"), "gram"))
    near = counts.withColumn("r", best).where(F.col("r") <= size).drop("r")
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = near.withColumn("r", best).where(F.col("r") <= size).select("lang", "gram", "n").toArrow()  # size rows a language
    out = {}
    langs = np.array(top.column("lang").to_pylist(), dtype=object)
    keys, n = top.column("gram").to_numpy().view(np.uint64), top.column("n").to_numpy()
    for lang in sorted(set(langs.tolist())):
        out[lang] = ranked(keys[langs == lang], n[langs == lang], size)
    return out


class Profiles:
    """Languages by name, with one list for all: each n-gram (sorted) with the languages that rank it."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE) -> None:
        self.names, self.size = sorted(profiles), size
        grams = np.concatenate([np.empty(0, np.uint64), *(profiles[x] for x in self.names)])
        order = np.argsort(grams, kind="stable")
        self.grams, self.starts = np.unique(grams[order], return_index=True)
        self.starts = np.r_[self.starts, len(grams)]
        sizes = [len(profiles[x]) for x in self.names]
        self.lang = np.repeat(np.arange(len(sizes)), sizes)[order].astype(np.int32)
        self.rank = np.concatenate([np.empty(0, np.int64), *(np.arange(n) for n in sizes)])[order].astype(np.int32)

    def distances(self, profile: np.ndarray) -> np.ndarray:
        """Of a document's ranked n-grams to each language, from 0 to 1."""
        at = np.minimum(np.searchsorted(self.grams, profile), max(0, len(self.grams) - 1))
        place = np.flatnonzero(self.grams[at] == profile) if len(self.grams) else np.empty(0, np.int64)
        first, n = self.starts[at[place]], self.starts[at[place] + 1] - self.starts[at[place]]
        each = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]] if len(n) else first, n) + np.arange(n.sum())
        nearer = self.size - np.minimum(np.abs(self.rank[each] - np.repeat(place, n)), self.size)
        return 1 - np.bincount(self.lang[each], nearer, len(self.names)) / (self.size * len(profile))

    def nearest(self, profile: np.ndarray) -> tuple[str, float, float]:
        """The nearest language, the first by name of several, its distance and that of the next one (1 if there is none)."""
        far = self.distances(profile)
        best = int(np.argmin(far))
        rest = np.delete(far, best)
        return self.names[best], float(far[best]), float(rest.min()) if rest.size else 1.0


def classify(text: str | None, parts: list[Profiles], size: int = PROFILE) -> tuple[str, float]:
    """Language and score; parts hold the languages in the order of their names."""
    x = _spaced(text) if text and parts else None
    if x is None:
        return UNKNOWN, 0.0
    profile = ranked(*ngrams(x), size)
    found = [p.nearest(profile) for p in parts]
    name, first, _ = min(found, key=lambda f: f[1])
    second = min([f[2] for f in found if f[0] == name] + [f[1] for f in found if f[0] != name])
    return name, second / (first + second) if first + second else 1.0


def as_known(profiles: dict[str, np.ndarray], size: int = PROFILE) -> list[Profiles]:
    names = sorted(profiles)
    return [Profiles({x: profiles[x] for x in names[i : i + LANGUAGES]}, size) for i in range(0, len(names), LANGUAGES)]


def _predict(known_of, size: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in nonempty(batches):
        got = [classify(t, known_of.value, size) for t in b.column(2).to_pylist()]
        yield batch(schema, b.column(0), b.column(1), [x for x, _ in got], [s for _, s in got])


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], held_out: Column | None = None, size: int = PROFILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (from 0.5 if the two nearest languages are as far, up to 1) for each row of docs.

    A text that is null or has no letter, and any text if no language was learned, gives `und` and 0. Ties go to the
    language that comes first by name. A very long text is counted piece by piece. Repeated rows give repeated rows; extra columns play no part; an empty table gives
    an empty one.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(as_known(profiles, size))  # 12 bytes for each of PROFILE n-grams a language
    return rows.mapInArrow(partial(_predict, known, size, _PREDICTED), "doc_id long, held_out boolean, lang_pred string, score double")
