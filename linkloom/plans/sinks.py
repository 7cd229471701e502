"""Results to files: sorted text, JSON arrays, manifests. Tasks write them, wherever the cluster keeps its files; single files are
joined from their pieces there and moved into place."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import constants as C
from linkloom.functions.urls import manifest_line, object_url


def run_id(now: datetime | None = None, unique: bool = False) -> str:
    stamp = (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H%M")
    return f"{stamp}-{uuid.uuid4().hex[:8]}" if unique else stamp


def shared(spark: SparkSession, path: str):
    """The file system of a path, as the cluster names it, and the path there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.setWriteChecksum(False)
    return files, at


def make_folder(spark: SparkSession, folder: str) -> None:
    files, at = shared(spark, folder)
    files.mkdirs(at)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = shared(spark, path)
    return files.exists(at)


def write_whole(lines: DataFrame, path: str, head: bytes = b"", between: str = "\n", tail: bytes = b"\n", none: bytes = b"") -> None:
    """lines: one string column, sorted. One file of them, with `between` each two; `none` where there are no lines.

    Tasks write the pieces, a file for each range of the order; these are joined in the file system they lie in, byte by
    byte and without being held, into a file beside the target, which it replaces in one step."""
    spark = lines.sparkSession
    pieces = f"{path}.pieces-{uuid.uuid4().hex[:8]}"
    lines.write.option("lineSep", between).text(pieces)
    files, at = shared(spark, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(pieces)
    found = sorted((s.getPath().getName(), s.getLen(), s.getPath()) for s in files.listStatus(folder) if s.getLen() and s.getPath().getName().startswith("part-"))
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = files.create(part, True)
    if found:
        out.write(bytearray(head))
        for i, (_, size, piece) in enumerate(found):
            source = files.open(piece)
            last = len(between.encode()) if i == len(found) - 1 else 0
            spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size - last)
            source.close()
        out.write(bytearray(tail))
    else:
        out.write(bytearray(none))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else files.getUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(files.makeQualified(part), files.makeQualified(at), how)
    files.delete(folder, True)


def write_lines(frame: DataFrame, path: str, column: str = "url") -> None:
    """One file of sorted lines; empty if there are none."""
    write_whole(frame.select(F.col(column).alias("value")).orderBy("value"), path)


def write_table(frame: DataFrame, path: str, *order: str) -> None:
    """The scalable form: sorted Parquet, in as many files as the data needs."""
    frame.orderBy(*order).write.mode("overwrite").parquet(path)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(["  " + json.dumps(r, indent=2).replace("\n", "\n  ") for r in b.to_pylist()], pa.string())], ["value"])


def write_json_array(frame: DataFrame, path: str, *order: str) -> None:
    """An array with indent 2, ASCII only, fields in the frame's order, no newline at the end."""
    write_whole(frame.orderBy(*order).mapInArrow(_rendered, "value string"), path, b"[\n", ",\n", b"\n]", b"[]")


def write_verify_outputs(verified: DataFrame, dead: DataFrame, folder: str) -> None:
    make_folder(verified.sparkSession, folder)
    write_json_array(verified, f"{folder}/verified.json", "url")
    write_json_array(dead, f"{folder}/dead.json", "url")
    write_whole(verified.orderBy("url").select(object_url(F.col("url")).alias("value")), f"{folder}/verified.txt")
    write_lines(dead, f"{folder}/dead.txt")
    write_lines(verified.select(manifest_line(F.col("url")).alias("line")), f"{folder}/s5cmd_download.txt", "line")


def write_verify_tables(verified: DataFrame, dead: DataFrame, folder: str) -> None:
    """The scalable form of the same: tables verified, dead and manifest, written by all tasks, sorted."""
    write_table(verified, f"{folder}/verified", "url")
    write_table(dead, f"{folder}/dead", "url")
    write_table(verified.select(manifest_line(F.col("url")).alias("line")), f"{folder}/manifest", "line")


def append_hits(hits: DataFrame, folder: str, part: int | None = None) -> int:
    """hits: strategy, url. A file for each strategy, which is there even if nothing was hit; or, of a part of a sweep, files
    named by it and only for strategies with hits, which join_hits() makes one. How many files could not be written."""
    spark, errors = hits.sparkSession, 0
    make_folder(spark, folder)
    for strategy, name in C.HIT_FILES.items():
        rows = hits.where(F.col("strategy") == strategy).select("url").distinct()
        if part is not None and not rows.limit(1).count():
            continue
        try:
            write_lines(rows, f"{folder}/{name}" if part is None else f"{folder}/{name.removesuffix('.txt')}.{part:06d}.txt")
        except Py4JJavaError:
            errors += 1
    return errors


def join_hits(spark: SparkSession, hits: DataFrame, folder: str) -> int:
    """One file for each strategy in place of those of the parts."""
    errors = append_hits(hits, folder)
    files, at = shared(spark, folder)
    if not errors:
        for s in files.listStatus(at):
            if re.search(r"\.\d{6}\.txt$", s.getPath().getName()):
                files.delete(s.getPath(), False)
    return errors
