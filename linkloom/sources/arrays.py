"""JSON arrays of any size, read by all tasks.

Whether a byte is within a string, and how deep, depends on all bytes before it. So each chunk first tells what it does to
either: its end state and its change of depth, for each state it may begin in. These transitions compose, from the first
chunk to the last, to the state that each chunk really begins in; then each task cuts its chunk into elements, and reads on
for the one that the next chunk ends. An array may have more bytes than a row may hold; an element may not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 16 << 20
#: Bytes of a chunk that a task holds at once, but for an element that is longer.
PIECE = 1 << 20
OUTSIDE, STRING, ESCAPE = 0, 1, 2
_MARKS, _IN_STRING = re.compile(rb'["\[\]{},]'), re.compile(rb'["\\]')


def opened(uri: str):
    """The file system and path of a URI, as Spark names files: the path is not escaped."""
    from pyarrow import fs

    found = re.match(r"^([a-zA-Z][a-zA-Z0-9+.-]*):(?://([^/]*))?(/.*)$", uri)
    if not found or found[1] == "file":
        return fs.LocalFileSystem(), found[3] if found else uri
    return fs.FileSystem.from_uri(f"{found[1]}://{found[2] or ''}/")[0], found[3]


def marks(data: bytes, state: int, depth: int) -> Iterator[tuple[int, int]]:
    """(position, depth after it) of what opens, parts and closes, outside of strings; and last (length, depth) with the state
    of the end put in place of the position as -1 - state."""
    at = 0
    if state == ESCAPE:
        at, state = 1, STRING if data else ESCAPE
    while at < len(data):
        found = (_IN_STRING if state == STRING else _MARKS).search(data, at)
        if not found:
            break
        at, mark = found.end(), data[found.start()]
        if state == STRING:
            if mark == 0x22:
                state = OUTSIDE
            elif at < len(data):
                at += 1
            else:
                state = ESCAPE
        elif mark == 0x22:
            state = STRING
        else:
            depth += (mark in b"[{") - (mark in b"]}")
            yield found.start(), depth
    yield -1 - state, depth


def transition(data: bytes) -> list[tuple[int, int]]:
    """End state and change of depth for each state at the beginning."""
    out = []
    for state in (OUTSIDE, STRING, ESCAPE):
        *_, (end, depth) = marks(data, state, 0)
        out.append((-1 - end, depth))
    return out


def transition_of(read, at: int, chunk: int, piece: int = PIECE) -> list[tuple[int, int]]:
    """transition() of a chunk, composed of those of its pieces."""
    out = [(state, 0) for state in (OUTSIDE, STRING, ESCAPE)]
    for start in range(at, at + chunk, piece):
        data = read(start, min(piece, at + chunk - start))
        if not data:
            break
        step = transition(data)
        out = [(step[state][0], depth + step[state][1]) for state, depth in out]
    return out


_MADE = pa.schema([("path", pa.string()), ("at", pa.int64()), *((f"{c}{s}", pa.int32()) for s in range(3) for c in ("end", "depth"))])


def _transitions(chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
            files, name = opened(path)
            with files.open_input_file(name) as f:
                found = transition_of(lambda a, n: f.read_at(n, a), at, chunk)  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path, at, *(x for pair in found for x in pair)), _MADE.types, strict=True)], schema=_MADE)


def elements(read, at: int, chunk: int, state: int, depth: int, size: int = PIECE) -> Iterator[bytes]:
    """read(position, n) gives bytes, size at once. The elements that begin in the chunk, whole: after a bracket or comma in it."""
    begun, parts, start = False, [], at
    while True:
        if not begun and start >= at + chunk:
            return
        # no piece lies on both sides of the chunk's end
        data = read(start, min(size, at + chunk - start) if start < at + chunk else size)
        if not data:
            return
        piece = 0
        for mark, after in marks(data, state, depth):
            if mark < 0:
                state, depth = -1 - mark, after
                break
            closes = after == 0 and data[mark : mark + 1] == b"]"
            if closes or (after == 1 and data[mark : mark + 1] in (b",", b"[")):
                if begun:
                    parts.append(data[piece:mark])
                    if whole := b"".join(parts).strip():
                        yield whole
                parts, piece, begun = [], mark + 1, not closes
                if start >= at + chunk:
                    return  # the next element is of that chunk
        if begun:
            parts.append(data[piece:])
        start += len(data)


def _elements(chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, at, state, depth in zip(*(c.to_pylist() for c in b.columns), strict=True):
            files, name = opened(path)
            with files.open_input_file(name) as f:
                some: list[bytes] = []
                for e in elements(lambda at, n: f.read_at(n, at), at, chunk, state, depth):  # noqa: B023
                    some.append(e)
                    if len(some) == 1000:
                        yield _texts(some)
                        some = []
                yield _texts(some)


def _texts(some: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e.decode("utf-8", "replace") for e in some], pa.string())], ["element"])


def array_elements(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """element: the text of each element of the arrays in the file, or in each file of the folder. A file that is no array
    raises an error; one whose array does not end has none."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", F.explode(F.expr(f"sequence(0L, length - 1, {chunk}L)")).alias("at"))
    found = files.repartition(F.col("path"), F.col("at")).mapInArrow(partial(_transitions, chunk), "path string, at bigint, " + ", ".join(f"{c}{s} int" for s in range(3) for c in ("end", "depth")))
    starts, bad, last, state, depth = [], set(), None, OUTSIDE, 0
    for r in sorted(found.collect(), key=lambda r: (r["path"], r["at"])):  # a row of eight numbers for each chunk
        if r["path"] != last:
            if last is not None and (state, depth) != (OUTSIDE, 0):
                bad.add(last)
            last, state, depth = r["path"], OUTSIDE, 0
            file, name = opened(last)
            with file.open_input_stream(name) as f:
                while (head := f.read(4096)) and not head.strip():
                    pass
            if not head.lstrip().startswith(b"["):
                raise ValueError(f"{last}: a JSON array is expected")
        starts.append((last, r["at"], state, depth))
        state, depth = r[f"end{state}"], depth + r[f"depth{state}"]
    if last is not None and (state, depth) != (OUTSIDE, 0):
        bad.add(last)
    chunks = spark.createDataFrame([s for s in starts if s[0] not in bad], "path string, at bigint, state int, depth int")
    return chunks.repartition(F.col("path"), F.col("at")).mapInArrow(partial(_elements, chunk), "element string")
