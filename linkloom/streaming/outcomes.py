"""Responses as a stream: what counts of each URL is the latest one, kept in state; failures are asked for again in time.

A URL's state is four small values. It goes when the URL has had no response for `keep` of event time; responses later than
that are late, and are dropped by the watermark, so that none of them can count as new. URLs are kept by bucket of their hash:
a call of Python is for a bucket, whose URLs are dealt with as arrays, so that no work of its own is done for each URL.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "request_url string, kind string, attempt int, status int, error string, headers string, fetched_at timestamp"
#: A bucket's URLs as an Arrow table of HELD.
STATE = "urls binary"
HELD = pa.schema([("request_url", pa.string()), ("at", pa.int64()), ("status", pa.int32()), ("attempt", pa.int32()), ("due", pa.int64())])
_NONE = -1
#: Stands for a missing time, in seconds: later than the watermark that a stream begins with, and earlier than all else.
UNTIMED = 1
#: Buckets of a stream, unless given; fixed for as long as its checkpoint lasts. One bucket's state, about 100 bytes for each of
#: its URLs, is held by a task and rewritten when a URL of it comes or is due; a call costs some 20 ms however small the bucket.
BUCKETS = 512
#: Responses of a bucket that are held, besides as many as it has URLs in the batch, before the latest of each URL are taken.
ROWS = 50_000


def _rank(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[us]").astype("int64")


def _load(state: GroupState) -> pd.DataFrame:
    table = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else HELD.empty_table()
    return table.to_pandas().set_index("request_url")


def _save(held: pd.DataFrame, state: GroupState) -> None:
    if held.empty:
        if state.exists:
            state.remove()
        return
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD) as out:
        out.write_table(pa.Table.from_pandas(held.reset_index(), HELD, preserve_index=False))
    state.update((sink.getvalue().to_pybytes(),))
    state.setTimeoutTimestamp(max(int(held["due"].min()), state.getCurrentWatermarkMs() + 1))


def _newest(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The latest response of each URL, by time and then status, of repeated ones the first."""

    def once(some: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(some, ignore_index=True)
        # sorted stably in descending order, so that the first of equal ones stays the first
        return rows.iloc[np.lexsort((-rows["code"].to_numpy(), -rows["at"].to_numpy()))].drop_duplicates("request_url")

    some, n, least = [], 0, ROWS
    for pdf in frames:
        some.append(pdf.assign(at=_rank(pdf["fetched_at"]), code=pdf["status"].fillna(_NONE).astype("int32")))
        n += len(pdf)
        if n > least:
            some = [once(some)]
            n, least = len(some[0]), 2 * len(some[0]) + ROWS
    return once(some)


def _latest(wait_ms: int, keep_ms: int, retries: int, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, mark, out = _load(state), state.getCurrentWatermarkMs(), []
    came = None if state.hasTimedOut else _newest(frames).set_index("request_url")
    # what is due and has no response in this batch: asked for again, or forgotten
    due = held["due"].to_numpy() < mark
    if came is not None:
        due &= ~held.index.isin(came.index)
    again = due & (held["status"].to_numpy() == _NONE) & (held["attempt"].to_numpy() < retries)
    if again.any():
        held.loc[again, "attempt"] += 1
        held.loc[again, "due"] = mark + wait_ms
        retried = held[again]
        out.append(pd.DataFrame({"request_url": retried.index, "kind": "retry", "attempt": retried["attempt"].to_numpy(), "status": None, "error": None, "headers": None, "fetched_at": pd.to_datetime(retried["at"].to_numpy(), unit="us")}))
    held = held[~(due & ~again)]
    if came is not None:
        known = held.reindex(came.index)
        new = known["at"].isna() | (came["at"] > known["at"]) | ((came["at"] == known["at"]) & (came["code"] > known["status"]))
        at = came["at"].where(new, known["at"]).astype("int64")
        status = came["code"].where(new, known["status"]).astype("int32")
        before = known["attempt"].fillna(0).astype("int32")
        attempt = before.where(~new | (status == _NONE), 0)
        wait = np.where((status == _NONE) & (attempt < retries), wait_ms, keep_ms)
        now = pd.DataFrame({"at": at, "status": status, "attempt": attempt, "due": np.maximum(at // 1000 + wait, mark + 1)}, index=came.index)
        held = pd.concat([held[~held.index.isin(came.index)], now])
        fresh = came[new]
        out.append(pd.DataFrame({"request_url": fresh.index, "kind": "outcome", "attempt": attempt[new].to_numpy(), "status": fresh["code"].where(fresh["code"] != _NONE).astype("Int32").array, "error": fresh["error"].array, "headers": fresh["headers"].array, "fetched_at": fresh["fetched_at"].array}))
    held.index.name = "request_url"
    _save(held, state)
    for part in out:
        yield part.astype({"attempt": "Int32", "status": "Int32"})


def outcomes(responses: DataFrame, keep: str = "30 days", wait: str = "10 minutes", retries: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """responses: a stream of request_url, status, error, headers, fetched_at (null: the earliest there can be,
    so late once the stream has gone beyond `keep`).

    Rows of kind `outcome` are responses that count more than all before them (by time, then status); the latest of them is
    the URL's, as verify.latest() has it. Rows of kind `retry` (attempt from 1) name URLs whose last answer is a failure of
    transport, `wait` after it, `retries` times at most; who asks again puts the answer into the stream.
    """
    to_ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    rows = responses.select("request_url", F.col("status").cast("int").alias("status"), "error", F.to_json("headers").alias("headers"), F.coalesce("fetched_at", F.timestamp_seconds(F.lit(UNTIMED))).alias("fetched_at"), F.pmod(F.xxhash64("request_url"), F.lit(buckets)).alias("bucket"))
    kept = rows.withWatermark("fetched_at", keep).groupBy("bucket")
    found = kept.applyInPandasWithState(partial(_latest, to_ms(wait), to_ms(keep), retries), OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("headers", F.from_json("headers", "map<string,string>")).withColumn("fetched_at", F.nullif("fetched_at", F.timestamp_seconds(F.lit(UNTIMED))))


def write(stream: DataFrame, target: str, checkpoint: str):
    """Appends to a table by batch, each batch under its own number, until what is there is taken in. State is in RocksDB, off
    the heap of the executors."""
    spark = stream.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def batch(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={n}")

    try:
        return stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(provider, before)
