"""Arrays that are cut anywhere, and responses as a stream."""

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkloom.operators import verify
from linkloom.sources import arrays, readers
from linkloom.streaming import outcomes

ENTRIES = [{"key": f"firmware/é{i}\\\"[]{{}},😀\n/{i}", "size": i, "modified": "m"} for i in range(60)] + [{"key": 3}, {"no": [1, [2, {}]]}, "],[\\", "\\\\", 5, None, [], [[1], "x"], {"key": "last", "nested": {"a": ["]"]}}]


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 1 << 20])
def test_elements_of_any_chunk(chunk):
    for text in (json.dumps(ENTRIES), json.dumps(ENTRIES, indent=2, ensure_ascii=False), " [ ] ", "[1]", '["\\\\", "\\""]'):
        data = text.encode()
        state, depth, found = arrays.OUTSIDE, 0, []
        for at in range(0, len(data), chunk):
            found += arrays.elements(lambda a, n: data[a : a + n], at, chunk, state, depth)
            end, change = arrays.transition(data[at : at + chunk])[state]
            state, depth = end, depth + change
        assert (state, depth) == (arrays.OUTSIDE, 0) and [json.loads(e) for e in found] == json.loads(text)


@pytest.mark.parametrize(("chunk", "size"), [(7, 3), (64, 5), (64, 64), (1000, 17), (1 << 20, 100)])
def test_chunks_are_read_in_pieces(chunk, size):
    """No read is of more than a piece, and elements and transitions are those of whole chunks."""
    data = json.dumps(ENTRIES, indent=2, ensure_ascii=False).encode()
    asked = []

    def read(a, n):
        asked.append(n)
        return data[a : a + n]

    state, depth, found = arrays.OUTSIDE, 0, []
    for at in range(0, len(data), chunk):
        found += arrays.elements(read, at, chunk, state, depth, size)
        assert arrays.transition_of(read, at, chunk, size) == arrays.transition(data[at : at + chunk])
        end, change = arrays.transition(data[at : at + chunk])[state]
        state, depth = end, depth + change
    assert [json.loads(e) for e in found] == json.loads(data) and max(asked) <= size


def test_listing_in_chunks(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    path = str(tmp_path / "a b" / "l%20.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(ENTRIES, f, indent=1, ensure_ascii=False)
    rows = arrays.array_elements(spark, path, 64).select(F.try_parse_json("element").alias("v"))
    got = sorted((r["key"], r["size"]) for r in readers._keyed(rows).collect())
    assert got == sorted((e["key"], e.get("size", 0)) for e in ENTRIES if isinstance(e, dict) and isinstance(e.get("key"), str))
    assert sorted((r["key"], r["size"]) for r in readers.firmware_listing(spark, path).collect()) == got
    for text, error in (("[1, 2", False), ('[{"key": "a}]', False), ("  {}", True), ("", False)):
        (tmp_path / "x.json").write_text(text)
        if error:
            with pytest.raises(ValueError):
                readers.firmware_listing(spark, str(tmp_path / "x.json"))
        else:
            assert readers.firmware_listing(spark, str(tmp_path / "x.json")).count() == 0


def test_outcomes_of_a_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda minutes: t0 + timedelta(minutes=minutes)
    waves = [
        [("u", 404, at(0)), ("u", 200, at(2)), ("v", None, at(1)), ("w", 200, None), ("x", 500, at(1))],
        [("u", 503, at(1)), ("u", 200, at(2)), ("v", None, at(30)), ("x", 200, at(1)), ("x", 404, at(1))],  # late, repeated, failed again, ties
        [("y", 200, at(200))],
        [("v", 200, at(210)), ("z", 200, at(211))],
        [("z", 404, at(400))],
    ]
    ddl, seen = "request_url string, status int, fetched_at timestamp", []
    old = {k: spark.conf.get(k) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    for n, wave in enumerate(waves):
        seen += wave
        rows = spark.createDataFrame(wave, ddl).select("request_url", "status", F.when(F.col("status").isNull(), "timeout").alias("error"), F.create_map(F.lit("Content-Length"), F.lit("7")).alias("headers"), "fetched_at")
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/wave={n}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/wave=*")
        outcomes.write(outcomes.outcomes(stream, keep="150 minutes", wait="10 minutes", retries=2), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        every = spark.read.parquet(f"{tmp_path}/in").drop("wave")
        let_through = spark.read.parquet(f"{tmp_path}/out")
        urls = every.select(F.col("request_url").alias("url")).distinct()
        whole = sorted(map(tuple, verify.classified(urls, every).collect()))
        assert [w[:-1] for w in sorted(map(tuple, verify.classified(urls, let_through.where("kind = 'outcome'").drop("kind", "attempt", "batch")).collect()))] == [w[:-1] for w in whole]
    for k, v in old.items():
        spark.conf.set(k, v)
    retried = [(r["request_url"], r["attempt"]) for r in let_through.where("kind = 'retry'").collect()]
    assert retried and set(retried) <= {("v", 1), ("v", 2)} and len(retried) == len(set(retried))
    per_url = {r["request_url"]: r["count"] for r in let_through.where("kind = 'outcome'").groupBy("request_url").count().collect()}
    assert per_url["u"] == 1 and per_url["x"] == 1  # in a batch one, and nothing for late or repeated ones


def test_outcomes_of_very_many_urls(spark, tmp_path):
    """No call of Python for each URL: 40,000 take little longer than a few."""
    rows = spark.range(40_000).select(F.concat(F.lit("u"), "id").alias("request_url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"), F.create_map(F.lit("a"), F.lit("b")).alias("headers"), F.lit(datetime(2024, 1, 1)).alias("fetched_at"))
    rows.write.parquet(f"{tmp_path}/in")
    began = time.monotonic()
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    assert outcomes.write(outcomes.outcomes(stream, buckets=64), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(45)
    assert time.monotonic() - began < 45
    assert spark.read.parquet(f"{tmp_path}/out").select("request_url").distinct().count() == 40_000
