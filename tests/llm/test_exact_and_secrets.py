import hashlib
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.llm import exact_dedup, queries, secrets


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[lowered(t)].append(i)
    return sorted(((i, max((x for x in by[lowered(t)] if x is not None), default=None), len(by[lowered(t)])) for i, t in rows), key=str)


def test_exact_dedup_odd_rows_and_colliding_digests(odd_docs, no_docs):
    want = plain([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    weak = lambda c: b""  # noqa: E731  all digests are equal
    for digest in (exact_dedup.sha256, weak):
        for salts in (1, 8):
            got = exact_dedup.exact_duplicates(odd_docs, salts=salts, digest=digest).collect()
            assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == want
            assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exact_dedup.exact_duplicates(no_docs).collect() == []


def test_exact_dedup_of_one_huge_group(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "Same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_duplicates(rows)
    assert got.where("kept").count() == 1001 and got.agg(F.max("group_size")).first()[0] == 2000


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(t):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


pieces = st.sampled_from(["password", "Secret", "TOKEN", "api_key", "apikey", "passwd", "=", ": ", " = ", '"', "'", "abc", "abcdef12", "AKIA", "ABCDEFGHIJ234567", "0123456789abcdef", "deadbeef", " ", "\n", "é", "ſecret", "toKen", "x"])


@given(st.lists(pieces, max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_scan_is_the_plain_one(text):
    assert secrets.scan(text) == plain_spans(text)


def test_query_against_plain_scan(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.op5_secret_scans(spark, sf).collect()}
    assert len(got) == docs.count()
    hits = 0
    for r in docs.select("doc_id", "text").collect():
        spans = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(r["text"] or ""))
        hits += bool(spans)
        assert got[r["doc_id"]]["spans"] == spans
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    assert hits


def test_ledger_is_incremental(spark, tmp_path):
    one = spark.createDataFrame([(1, "token = abcdefgh"), (2, "nothing"), (3, None), (4, "token = abcdefgh")], "doc_id long, text string")
    path = f"file://{tmp_path}/ledger"
    first = secrets.find_secrets(one, path)
    assert {r["doc_id"]: len(r["spans"]) for r in first.collect()} == {1: 1, 2: 0, 3: 0, 4: 1}
    assert spark.read.parquet(path).count() == 3
    more = one.union(spark.createDataFrame([(5, "AKIA" + "A" * 16), (6, "nothing")], "doc_id long, text string"))
    _, entries = secrets.scan_unseen(more, spark.read.schema(secrets.LEDGER).parquet(path))
    assert entries.count() == 1
    assert {r["doc_id"]: len(r["spans"]) for r in secrets.find_secrets(more, path).collect()}[5] == 1
    assert secrets.scan_unseen(more, spark.read.schema(secrets.LEDGER).parquet(path), rule_version=2)[1].count() == 4


def test_ledger_with_repeated_blobs(spark, tmp_path):
    one = spark.createDataFrame([(1, "token = abcdefgh"), (2, "none")], "doc_id long, text string")
    path = f"file://{tmp_path}/ledger"
    for _ in range(2):  # as two runs at one time do
        secrets.scan_unseen(one)[1].write.mode("append").parquet(path)
    assert sorted((r["doc_id"], len(r["spans"])) for r in secrets.find_secrets(one, path).collect()) == [(1, 1), (2, 0)]


def test_secrets_odd_rows(odd_docs, no_docs):
    got = secrets.find_secrets(odd_docs).collect()
    assert len(got) == 11 and all(not r["spans"] for r in got)
    assert secrets.find_secrets(no_docs).collect() == []


def test_exact_dedup_deals_large_groups_to_several_keys(spark, monkeypatch):
    same = [(None if i % 4 == 0 else i, "Same" if i % 2 else "same") for i in range(900)]
    rows = same + [(i, f"pair {i // 2}") for i in range(1000, 1400)] + [(i, f"own {i}") for i in range(2000, 2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for shares in (1, 16, 10**5):  # no group, one, all but none are large
        monkeypatch.setattr(exact_dedup, "SHARES", shares)
        got = exact_dedup.exact_duplicates(df).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == plain(rows)
