"""What other programs use: SQL functions, the data source, tables for lookups, the corpus as it changes."""

import io
import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from linkloom import sql
from linkloom.functions import tokens, urls
from linkloom.operators import extract
from linkloom.plans import sinks
from linkloom.sources import datasource, readers, tables
from linkloom.sources.corpus import Corpus

HARD = [
    " HTTP://Static.TP-Link.com/A b%28c%29.zip?q#f ", "https://h/x%20y+z&q=[1]~*!'", "//h/%C3%A9%zz/%", "", "mailto:x", "https://h/\ta\nb\\c\"d'e", "https://static.tp-link.com/x_GPL.TAR.gz", "https://h/gpl.7z\n",
    "https://h/%F0%9F%98%80/日本", "path/only gpl.zip",
]
NAMES = ["AX50v2_1.0.bin", "(B)TapoC200(US)_V1_Build 2021.zip", "Archer_C7 v5_EU_1.2.0", "Deco M5_200714.rar", "TL-WR841N_up_x", "x", "", "ArcherAX21 US 1.2a.tar"]
CDX = ['["original"]\n["u1"]\nbad\n["u2"]\r\n["u1"]\n[]\n["key"]\n["late"]', '["original"]\n["u1"]', "", "x", '["h"]\n[]\n[]', '["h"]\n[null]\n[""]\n["é"]\n[]']


def test_sql_functions_equal_the_expressions(spark):
    sql.register(spark)
    spark.createDataFrame([(u,) for u in HARD], "url string").createOrReplaceTempView("hard")
    got = spark.sql("SELECT url_canonical(url), url_origin(url_canonical(url)), url_regional(url_canonical(url), 'r'), url_object(url), url_copy_line(url), url_is_archive(url), url_host(url) FROM hard").collect()
    u, c = F.col("url"), urls.canonical(F.col("url"))
    assert got == spark.table("hard").select(c, urls.origin_url(c), urls.regional_url(c, F.lit("r")), urls.object_url(u), urls.manifest_line(u), urls.is_archive(u), urls.netloc(u)).collect()
    spark.createDataFrame([(n,) for n in NAMES], "name string").createOrReplaceTempView("names")
    assert spark.sql("SELECT model_token(name) FROM names").collect() == spark.table("names").select(tokens.model_token(F.col("name"))).collect()
    plan = spark.sql("SELECT * FROM hard WHERE url_is_archive(url)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_cdx_table_function(spark):
    sql.register(spark)
    spark.createDataFrame(list(enumerate(CDX)), "i int, body string").createOrReplaceTempView("cdx")
    got = sorted(map(tuple, spark.sql("SELECT i, c.nth, c.url, c.resume_key FROM cdx, LATERAL cdx_page(body) AS c(nth, url, resume_key)").collect()))
    parsed = spark.table("cdx").select("i", extract.cdx_rows(F.col("body")).alias("r"))
    assert got == sorted(map(tuple, parsed.select("i", F.posexplode("r.urls").alias("nth", "url"), "r.resume_key").collect())) and len(got) == 4


def test_cdx_table_function_reads_each_page_once(spark):
    """Pages that come out otherwise when they are computed again, as lists do that are collected in the order of a shuffle."""
    sql.register(spark)
    made = F.udf(lambda i: f'["original"]\n["{uuid.uuid4()}"]\n["{i}"]\n[]\n["key"]')
    spark.range(9).repartition(3).select("id", made("id").alias("body")).createOrReplaceTempView("unsteady")
    rows = spark.sql("SELECT id, c.nth, c.url, c.resume_key FROM unsteady, LATERAL cdx_page(body) AS c(nth, url, resume_key)")
    assert sorted(r["url"] for r in rows.where("nth = 1").collect()) == [str(i) for i in range(9)]
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def runs(tmp_path):
    for run, name, text in (("r1", "a.txt", "https://h/1\nhttps://h/2\r\n\n"), ("r1", "b.txt", "https://h/é"), ("r2", "a.txt", "https://h/3\n" * 3), ("r2", "a.000001.txt", "https://h/4\n"), ("r2", "no.csv", "x"), ("run=r3/source=c%20d", "part-0.txt", "https://h/5\n")):
        (tmp_path / "in" / run).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / run / name).write_bytes(text.encode())
    return str(tmp_path / "in")


def test_scrapes_by_name(spark, runs):
    datasource.register(spark)
    for folder in (runs, f"file://{runs}"):
        rows = spark.read.format("scrapes").load(folder)
        assert sorted(map(tuple, rows.collect())) == sorted([("r1", "a", "https://h/1"), ("r1", "a", "https://h/2"), ("r1", "a", ""), ("r1", "b", "https://h/é"), *[("r2", "a", "https://h/3")] * 3, ("r2", "a", "https://h/4"), ("r3", "c d", "https://h/5")])
        assert rows.where("run = 'r2' AND url LIKE '%4'").count() == 1 and rows.where("source IN ('b', 'c d') AND run <> 'r3'").count() == 1


def test_filters_choose_files(runs):
    reader = datasource.ScrapesReader(runs)
    files = lambda: sorted(os.path.basename(x.path) for p in reader.partitions() for x in p.pieces)
    assert len(files()) == 5
    left = list(reader.pushFilters([EqualTo(("run",), "r2"), In(("source",), ("a", "b")), GreaterThan(("url",), "x"), EqualTo(("url",), "y")]))
    assert [type(f) for f in left] == [GreaterThan, EqualTo]
    assert files() == ["a.000001.txt", "a.txt"]


@pytest.mark.parametrize("text", [b"", b"\n", b"a", b"a\n", b"\n\na\n\n", b"ab\r\n" * 7, "é\n日本\nxyz".encode(), b"one very long line\nb\n" + b"c" * 40, b"x" * 23 + b"\n"])
@pytest.mark.parametrize("chunk", [1, 5, 64])
def test_ranges_hold_each_line_once(text, chunk, monkeypatch):
    monkeypatch.setattr(datasource, "CHUNK", chunk)
    whole = text.split(b"\n")
    whole = whole[:-1] if not whole[-1] else whole
    for split in (*range(1, 12), 100):
        got = [line for start in range(0, len(text), split) for lines in datasource.lines_in(io.BytesIO(text), start, min(start + split, len(text))) for line in lines]
        assert got == whole, (split, got)


def test_large_files_are_split_and_small_ones_share_a_task(spark, runs, monkeypatch):
    assert len(datasource.ScrapesReader(runs).partitions()) == 1 and datasource.ScrapesReader(runs + "/none").partitions() == []
    split = [p for p in datasource.ScrapesReader(runs, 8).partitions() for p in p.pieces]
    assert max(p.end - p.start for p in split) == 8 and sum(p.end - p.start for p in split) == sum(os.path.getsize(f) for f in {p.path for p in split})
    datasource.register(spark)
    read = lambda **options: sorted(map(tuple, spark.read.format("scrapes").options(**options).load(runs).collect()))
    assert read(split_bytes=8) == read() and len(read()) == 9
    pieces = [datasource.Piece("", "", "", 0, n) for n in (10, 20, 30, 100, 1)]
    monkeypatch.setattr(datasource, "OPENING", 5)
    assert [[p.end for p in d.pieces] for d in datasource.dealt(pieces, 50)] == [[10, 20], [30], [100], [1]]


def test_lookups_do_not_move_the_table(spark, tmp_path):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(2000).selectExpr("concat('https://h/a%20', id) AS request_url", "IF(id % 3 = 0, 200, 404) AS status", "CAST(NULL AS STRING) AS error", "timestamp_seconds(id) AS fetched_at")
        later = rows.where("status = 200 AND CAST(substring(request_url, 15) AS INT) % 2 = 0").selectExpr("replace(request_url, 'https://h', 'https://s3.amazonaws.com/h') AS request_url", "404 AS status", "error", "fetched_at + INTERVAL 1 DAY AS fetched_at")
        table = tables.response_table(rows.unionByName(later), "test_responses", f"{tmp_path}/r", 8)
        asked = spark.range(3000).selectExpr("concat('http://H/a ', id) AS url", "id")
        got = tables.existing_in(asked, table)
        assert {r["id"] for r in got.collect()} == {i for i in range(2000) if i % 3 == 0 and i % 2}
        plan = got._jdf.queryExecution().executedPlan().toString()
        final = plan.split("Initial Plan")[0]
        assert final.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in got._jdf.queryExecution().toString()
        known = tables.discovery_table(asked.where("id < 2500"), "test_known", f"{tmp_path}/k", 8)
        assert sorted(r["id"] for r in tables.unseen_in(asked, known).collect()) == list(range(2500, 3000))
        known.drop()
        again = tables.BucketedTable(spark, "test_known_again", f"{tmp_path}/k", "url", 8).attach("url string")
        assert tables.unseen_in(asked, again).count() == 500 and again.read().count() == 2500
        again.drop()
        table.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_corpus_follows_its_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("linkloom.sources.corpus.COMPACT", 3)
    folder = tmp_path / "scrapes"
    folder.mkdir()
    corpus = Corpus(spark, str(folder), str(tmp_path / "state"))
    steps = [
        {"r1/a.txt": "https://h/1\nhttp://h/1\nhttps://h/2\n", "r1/b.txt": "https://h/2\n"}, {}, {"r2/a.txt": "https://h/3\nhttps://h/1\n"}, {"r1/a.txt": "https://h/2\n"}, {"r1/b.txt": None, "r2/a.txt": "https://h/9\n"},
        {"r1/a.txt": None}, {"r3/é x%20+[1].txt": "https://h/7\n"}, {"r3/é x%20+[1].txt": "https://h/8\n"}, {"r3/é x%20+[1].txt": None},
    ]
    read = []
    for nth, step in enumerate(steps):
        for name, text in step.items():
            path = folder / name
            path.parent.mkdir(exist_ok=True)
            if text is None:
                path.unlink()
            else:
                path.write_text(text)
                os.utime(path, (nth * 10 + 1_000_000, nth * 10 + 1_000_000))
        read.append(corpus.update())
        assert sorted(r["url"] for r in corpus.urls().collect()) == sorted(r["url"] for r in readers.read_corpus(spark, str(folder)).collect())
    assert [(r["files_read"], r["files_gone"]) for r in read] == [(2, 0), (0, 0), (1, 0), (1, 1), (1, 2), (0, 1), (1, 0), (1, 1), (0, 1)] and corpus.version() == 8
    assert sinks.exists(spark, str(tmp_path / "state/manifest/6"))


def test_corpus_takes_in_files_that_change_while_it_reads(spark, tmp_path, monkeypatch):
    folder = tmp_path / "scrapes/r1"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("https://h/1\n")
    corpus = Corpus(spark, str(tmp_path / "scrapes"), str(tmp_path / "state"))

    def overtaken(spark, paths):
        lines = spark.createDataFrame(readers.lines_of_files(spark, paths).collect())
        with open(folder / "a.txt", "a") as f:
            f.write("https://h/2\n")
        return lines

    with monkeypatch.context() as during:
        during.setattr("linkloom.sources.corpus.lines_of_files", overtaken)
        corpus.update()
    assert corpus.update()["files_read"] == 1
    assert sorted(r["url"] for r in corpus.urls().collect()) == ["https://h/1", "https://h/2"]
