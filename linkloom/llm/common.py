"""What the operators share: tables in the shared folder, folds, bounded label samples, Arrow batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch where whole texts go to Python: bounds what one batch holds.
BATCH_ROWS = 256

_own: dict[str, SparkSession] = {}


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let no Arrow batch of this session hold more than so many rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only if that is unset and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    made = "file://" + tempfile.mkdtemp(prefix="linkloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _own.pop(path, None)


@atexit.register
def _tidy() -> None:
    for path, spark in list(_own.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended already
            _own.pop(path, None)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it again: lineage is cut and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/linkloom/{uuid.uuid4().hex}-{name}"
    _own[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables of one operator's run in the shared folder, deleted when their results are written elsewhere."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        self.paths.append((df.sparkSession, path))
        return out

    def clear(self) -> None:
        while self.paths:
            delete(*self.paths.pop())


def fresh(frame: DataFrame, name: str) -> str:
    """The name, with underscores until no column of the frame has it in any case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(parts)


def share(key: Column, seed: int = 7) -> Column:
    """A hash of the key as a number from 0 to 1, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def labelled(labels: DataFrame, column: str, learn: Column) -> DataFrame:
    """doc_id and y (0 or 1). Repeated labels of an id count once, with the largest value; rows with a null id or label do not count."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learn)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )


def labelled_sample(labels: DataFrame, column: str, learn: Column, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """About per_class labelled ids of either class, chosen by hash; and for each class the share of its rows that was taken.

    The result has at most about 2 * per_class rows at any size of the input, so it may be broadcast.
    """
    clean = labelled(labels, column, learn)
    found = {r["y"]: r["n"] for r in clean.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rates = {y: min(1.0, per_class / n) for y, n in found.items()}
    rate = F.lit(0.0)
    for y, r in rates.items():
        rate = F.when(F.col("y") == y, F.lit(r)).otherwise(rate)
    return clean.where(share(F.col("doc_id")) < rate), rates


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what is read of documents: doc_id long and text, null as empty. Other columns, whatever their names, play no part."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


class WordIds(dict):
    """Word (bytes) to a hash bucket, remembered for up to a million words."""

    def __init__(self, bits: int, seed: int) -> None:
        super().__init__()
        self.mask, self.seed = (1 << bits) - 1, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word, self.seed) & self.mask
        return got


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def nonempty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)
