"""Scraped lists as a data source: spark.read.format("scrapes").load(folder), once registered.

A run's folder has a file for each of its sources (or folders run=... and source=... have files that tasks wrote). Large files
are read in ranges of bytes, by several tasks, and small ones share a task; a line belongs to the range that its first
byte lies in. Conditions on run or source (equal, or one of several) are pushed down and choose files before any is opened.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "run string, source string, url string"
#: Bytes that are read at once, and so held by a task.
CHUNK = 4 << 20
#: Bytes of a task, about, where the option split_bytes does not say otherwise; and what opening a file counts for.
SPLIT, OPENING = 64 << 20, 512 << 10


@dataclass
class Piece:
    """Bytes from start up to end of a list."""

    path: str
    run: str
    source: str
    start: int
    end: int


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


def _open(uri: str):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else posixpath.abspath(uri))
    return files, path


def named(path: str) -> tuple[str, str]:
    """Run and source of a list: its folder and its name, or what folders run=... and source=... say."""
    *folders, name = path.split("/")
    keys = {k: unquote(v) for k, at, v in (f.partition("=") for f in folders) if at}
    return keys.get("run", folders[-1] if folders else ""), keys.get("source", re.sub(r"(\.\d{6})?\.txt$", "", name))


def pieces_of(files: Iterable[tuple[str, int]], split: int) -> Iterator[Piece]:
    """files: path and size."""
    for path, size in files:
        for start in range(0, size, split):
            yield Piece(path, *named(path), start, min(start + split, size))


def dealt(pieces: Iterable[Piece], split: int) -> list[Pieces]:
    """Neighbours share a task while their bytes, and OPENING for each, stay within split."""
    made, held = [], split
    for p in pieces:
        cost = p.end - p.start + OPENING
        if held + cost > split:
            made.append(Pieces([]))
            held = 0
        made[-1].pieces.append(p)
        held += cost
    return made


def lines_in(stream, start: int, end: int) -> Iterator[list[bytes]]:
    """The lines, without their ends, whose first byte lies from start up to end; some at a time."""
    at = max(0, start - 1)  # one byte before: a line may begin right at start
    stream.seek(at)
    rest, inside = b"", start == 0
    while chunk := stream.read(CHUNK):
        if not inside:  # still in the line of the range before
            cut = chunk.find(b"\n")
            if cut < 0:
                at += len(chunk)
                continue
            at, chunk, inside = at + cut + 1, chunk[cut + 1 :], True
        if at >= end:
            return
        rest += chunk
        if at + len(rest) >= end and (last := rest.find(b"\n", end - at - 1)) >= 0:
            yield rest[:last].split(b"\n")
            return
        *lines, rest_now = rest.split(b"\n")
        if lines and at + len(rest) - len(rest_now) <= end:
            yield lines
            at, rest = at + len(rest) - len(rest_now), rest_now
    if rest and at < end:
        yield [rest]


class ScrapesReader(DataSourceReader):
    def __init__(self, folder: str, split: int = SPLIT) -> None:
        self.folder = folder
        self.split = split
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("run",), ("source",)):
                yield f  # for Spark to apply
            else:
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self) -> list[Pieces]:
        from pyarrow import fs

        files, root = _open(self.folder)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        chosen = []
        for f in sorted(found, key=lambda f: f.path):
            run, source = named(f.path)
            if f.is_file and f.base_name.endswith(".txt") and run in self.wanted.get("run", {run}) and source in self.wanted.get("source", {source}):
                chosen.append((f.path, f.size))
        return dealt(pieces_of(chosen, self.split), self.split)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.folder)
        schema = pa.schema([("run", pa.string()), ("source", pa.string()), ("url", pa.string())])
        for piece in partition.pieces:
            with files.open_input_file(piece.path) as stream:
                for lines in lines_in(stream, piece.start, piece.end):
                    yield self._batch(piece, lines, schema)

    @staticmethod
    def _batch(piece: Piece, lines: list[bytes], schema: pa.Schema) -> pa.RecordBatch:
        urls = pa.array([line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines], pa.string())
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([piece.run] * n, pa.string()), pa.array([piece.source] * n, pa.string()), urls], schema=schema)


class Scrapes(DataSource):
    """Options: path, the folder of the runs; split_bytes, the bytes of a task. Columns: run, source, url (as it stands in the list)."""

    @classmethod
    def name(cls) -> str:
        return "scrapes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ScrapesReader:
        return ScrapesReader(self.options["path"], max(1, int(self.options.get("split_bytes", SPLIT))))


def register(spark: SparkSession) -> None:
    """By its name, for this session; filters of Python sources are pushed down from now on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Scrapes)
