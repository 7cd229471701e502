"""Secret scans with an incremental ledger of blobs.

Every version of a text is a blob, addressed by its SHA-256. The ledger holds one row for each pair of blob and rule
version that was ever scanned, with what was found. A run scans only the pairs that the ledger lacks, each blob once
however many paths hold it, and joins the findings of all versions back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import batch, nonempty, small_batches, texts, written

#: Stands for the rules below in the ledger; a change of rules needs another.
RULE_VERSION = 1
KINDS = ("assign", "access", "hex")

# The rules' patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are taken whole, so those of 24 are the same as all runs without the short ones
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

_KEYWORD_NEAR = re.compile(r"""(?:[dD]|[tT]|[nN]|[yY])["']?\x20*[:=]""")  # how each keyword ends


def scan(text: str) -> list[tuple[str, int, int]]:
    """Spans of a text as (kind, start, end), in code points, by start and then by kind as listed."""
    out = []
    if _KEYWORD_NEAR.search(text):  # without one, no keyword with a value can be there
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_FOUND = pa.schema([("blob", pa.binary()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in nonempty(batches):
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in b.column(1).to_pylist()]
        yield batch(_FOUND, b.column(0), found)


LEDGER = "blob binary, rule_version int, spans array<struct<kind:string,start:bigint,end:bigint>>"


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths, entries): paths has doc_id and blob for each row of docs; entries are the ledger rows that this run adds.

    Only the digests meet to find out which blobs are unseen. Of each of these one row is taken, by its doc_id, and only
    those rows' texts are scanned; a group of copies of any size costs one scan and never meets in one task.
    """
    small_batches(docs.sparkSession)
    rows = texts(docs, id_col, text_col).withColumn("blob", F.unhex(F.sha2("text", 256)))
    paths, _ = written(rows.select("doc_id", "blob"), "paths")
    unseen = paths.groupBy("blob").agg(F.min("doc_id").alias("at"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    # the few bytes of `unseen` are the side that is hashed; texts are not sorted
    chosen = rows.join(unseen.select(F.col("blob").alias("b"), "at").hint("shuffle_hash"), rows["doc_id"].eqNullSafe(F.col("at")) & (rows["blob"] == F.col("b"))).select("blob", "text")
    found = chosen.mapInArrow(_scan, "blob binary, spans array<struct<kind:string,start:bigint,end:bigint>>")
    entries = found.groupBy("blob").agg(F.first("spans").alias("spans"))  # rows repeated with their id
    return paths, entries.select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def find_secrets(docs: DataFrame, ledger_path: str | None = None, rule_version: int = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob and spans (array of kind, start, end) for each row of docs, null text as empty.

    With a ledger_path, the ledger there is read if it is there, and what this run scans is appended; else the run starts
    from an empty ledger. Repeated rows and copies give a row each; a null doc_id stays null; an empty table gives an
    empty one. A very long text is scanned whole. Extra columns of docs play no part. Pairs that the ledger holds more than
    once, as after runs at one time, count once.
    """
    spark = docs.sparkSession
    known = None
    if ledger_path is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            known = spark.read.schema(LEDGER).parquet(ledger_path)
    paths, entries = scan_unseen(docs, known, rule_version, id_col, text_col)
    if ledger_path is None:
        ledger, _ = written(entries, "ledger")
    else:
        entries.write.mode("append").parquet(ledger_path)
        ledger = spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rule_version") == rule_version)
    hits = ledger.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))  # runs at one time may add a blob twice
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", empty).alias("spans"))
