import json

import pytest
from pyspark.sql import functions as F

from linkloom import cli, queries
from linkloom.operators import extract, generate, verify
from linkloom.plans import sinks
from linkloom.plans.runs import BruteforceRun, ScrapeRun, VerifyRun
from linkloom.plans.sweep import probe_regions, sweep
from linkloom.sources import fetch, pipelines, readers
from linkloom.sources.spec import SPECS, SourceSpec
from linkloom.streaming import dedup

HOST = "https://static.tp-link.com"
RESPONSES = "request_url string, status int, error string, headers map<string,string>, body string, final_url string, fetched_at timestamp"


def column(spark, f, body):
    return spark.createDataFrame([(body,)], "body string").select(f(F.col("body")).alias("o")).first()["o"]


def test_product_tree_and_pages(spark):
    assert column(spark, extract.product_tree, "var productTree = [];") is None
    assert column(spark, extract.product_tree, 'var productTree = {"1":[{"href":"x"') is None
    tree = 'var productTree = {"1":[{"href":" %s/a b.zip "},{"href":"?model=AX","app_folder":"us"},{"href":"/no"}]}; </script>' % HOST
    pages = spark.createDataFrame([("us", tree), ("de", f'<a href="{HOST}/x.ZIP"> <a href="{HOST}/x.html">'), ("fr", "")], "region string, body string")
    rows = {(r["region"], r["kind"], r["url"], r["model"], r["app_folder"]) for r in extract.region_page_rows(pages).collect()}
    assert rows == {("us", "direct", f"{HOST}/a b.zip", None, None), ("us", "pair", None, "AX", "us"), ("de", "fallback", f"{HOST}/x.ZIP", None, None)}


def test_text_extractors(spark):
    assert column(spark, extract.href_urls, f'<a href=" {HOST}/OC300 1.20.7z"><a HREF="x">') == [f"{HOST}/OC300 1.20.7z"]
    assert column(spark, extract.text_urls, f"see {HOST}/a.zip. or ({HOST}/b.zip), http://x") == [f"{HOST}/a.zip", f"{HOST}/b.zip"]
    assert column(spark, extract.ndjson_urls, '{"url":"a"}\nbad\n\n{"x":1}\n{"url":""}') == ["a"]
    r = column(spark, extract.cdx_rows, '["original"]\n["u1"]\nbad\n["u2"]\n["u1"]\n[]\n["key"]\n["late"]')
    assert (r["urls"], r["resume_key"]) == (["u1", "u2"], "key")
    r = column(spark, extract.cdx_rows, '["original"]\n["u1"]')
    assert (r["urls"], r["resume_key"]) == (["u1"], None)
    assert column(spark, extract.crawl_indices, '[{"id":"a","cdx-api":"u"},{"id":"b"}]') == ["u"]
    assert column(spark, extract.code_search_urls, json.dumps({"total_count": 1, "items": [{"text_matches": [{"fragment": f"x {HOST}/a.zip,"}]}, {}]})) == [f"{HOST}/a.zip"]
    assert column(spark, extract.discourse_urls, json.dumps({"posts": [{"blurb": f"{HOST}/a.zip!"}]})) == [f"{HOST}/a.zip"]
    assert column(spark, extract.listing_urls, json.dumps({"data": {"children": [{"data": {"selftext": "", "url": f"{HOST}/a", "title": None}}], "after": "t"}})) == [f"{HOST}/a"]
    assert column(spark, extract.picker_regions, '<a href="/us/"><a href="//h/de/"><a href="/us/">') == ["us", "de"]
    assert column(spark, extract.wiki_repositories, '[{"html_url":"https://github.com/a","has_wiki":true},{"html_url":"https://evil/b","has_wiki":true},{"html_url":"https://github.com/c","has_wiki":false}]') == ["https://github.com/a"]
    assert column(spark, extract.index_models, '<a class=x href="?model=A&amp;B">x</a><a href="?model="></a><a href="?model=A&amp;B">') == ["A&B", "A&B"]


def test_search_pages(spark):
    rows = [(200, "u", f'<div class="yuRUbf"><a href="{HOST}/a.zip">x</a></div><a href="{HOST}/b.zip">'), (200, "u", f"text {HOST}/c.zip."), (429, "u", f"{HOST}/d"), (200, "https://consent.google.com/x", f"{HOST}/e"), (200, "u", f"Unusual Traffic {HOST}/f")]
    pages = spark.createDataFrame(rows, "status int, final_url string, body string")
    assert {r["url"] for r in pipelines.search_pages(pages).collect()} == {f"{HOST}/a.zip", f"{HOST}/c.zip"}


def test_generators(spark):
    paths = generate.date_paths(spark, "2024-02-28", "2024-03-01")
    assert paths.count() == 6 and generate.date_paths(spark, "2024-02-02", "2024-02-01").count() == 0
    names = spark.createDataFrame([("a.zip",)], "basename string")
    assert generate.date_candidates(names, generate.date_paths(spark, "2024-01-01", "2024-01-03")).count() == 30
    models, patterns = spark.createDataFrame([("AX",)], "model string"), spark.createDataFrame([("GPL_{model}",)], "pattern string")
    assert {r["url"] for r in generate.model_candidates(models, patterns).collect()} >= {f"{HOST}/resources/gpl/GPL_AX.tar.gz"}
    assert generate.candidates(spark, "all", names, models, patterns, paths.select("date_path").limit(0), cap=7, start="2024-01-01", end="2024-01-02").count() == 7
    with pytest.raises(ValueError):
        generate.candidates(spark, "none", names, models, patterns, paths)
    assert generate.region_codes(spark).count() == 676


def responses(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], RESPONSES)


def test_verify_run(spark, tmp_path):
    d = tmp_path / "scrapes" / "seed"
    d.mkdir(parents=True)
    (d / "a.txt").write_text(f"{HOST}/x GPL.zip\n{HOST}/x%20GPL.zip\n\nhttp://static.tp-link.com/y_gpl.zip\n{HOST}/search\n")
    head = {"Content-Length": "12", "ETag": "e", "x-amz-version-id": "null"}
    got = VerifyRun(spark, str(tmp_path), responses(spark, [(f"{HOST}/x%20GPL.zip", 200, None, head, None, None), (f"{HOST}/y_gpl.zip", None, "timeout", {}, None, None)])).run()
    assert got == {"total_urls": 2, "unique_urls": 2, "live": 1, "dead": 1}
    live = json.loads((tmp_path / "verified.json").read_text())
    assert list(live[0]) == list(verify.VERIFIED) and live[0]["size"] == 12 and live[0]["version_id"] is None
    assert json.loads((tmp_path / "dead.json").read_text())[0]["error_type"] == "timeout"
    assert (tmp_path / "verified.txt").read_text() == "s3://static.tp-link.com/x GPL.zip\n"
    assert (tmp_path / "s5cmd_download.txt").read_text().startswith("cp --if-size-differ 's3://")


def test_scrape_run_isolates_sources(spark, tmp_path):
    good = spark.createDataFrame([(f"{HOST}/b",), (f"{HOST}/a",), (f"http://static.tp-link.com/a",), ("",)], "url string")
    bad = good.select(F.raise_error(F.lit("no")).cast("string").alias("url"))
    run = ScrapeRun(spark, str(tmp_path), {"good": good, "bad": bad})
    out = run.run()
    assert out["sources_failed"] == ["bad"] and run.per_source_counts == {"good": (4, 2)}
    assert open(f"{out['run_dir']}/good.txt").read() == f"{HOST}/a\n{HOST}/b\n"


def test_bruteforce_run(spark, tmp_path):
    (tmp_path / "c.txt").write_text(f"{HOST}/upload/gpl-code/2024/202401/20240101/x_GPL.zip?q\n")
    (tmp_path / "l.json").write_text(json.dumps([{"key": "firmware/AX50v2_1.0.bin", "size": 1}, {"key": 3}, {"nokey": 1}]))
    hit = f"{HOST}/resources/gpl/AX50_GPL.zip"
    run = BruteforceRun(spark, str(tmp_path), responses(spark, [(hit, 200, None, {}, None, None)]), str(tmp_path / "l.json"), str(tmp_path / "c.txt"), start="2024-01-01", end="2024-01-01")
    out = run.run()
    assert out["hits_models"] == 1 and out["hits_dates"] == 0 and out["candidates_checked"] == 2 * 5 + 2 * 3 * 8
    assert (tmp_path / "scrapes").exists()
    run.dry_run, run.max_candidates = True, 4
    assert run.run()["candidates_enumerated"] == 4
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.firmware_listing(spark, str(tmp_path / "bad.json"))


def test_sweep_has_one_round(spark):
    page = lambda m, r, *files: (m, r, 200, "".join(f'<a href="{HOST}/{f}">' for f in files))
    pages = spark.createDataFrame([page("ax21", "us", "AX21_X60_GPL.zip"), page("X60", "us", "X60_M5_GPL.zip"), page("AX21", "pl", "AX21_pl_GPL.zip"), page("M5", "us", "M5_GPL.zip")], "model string, region string, status int, body string")
    seed, regions = spark.createDataFrame([("AX21",), ("none",)], "model string"), spark.createDataFrame([("us",), ("pl",)], "region string")
    got = {(r["model"], r["region"]) for r in sweep(seed, seed.limit(0), regions, pages).collect()}
    assert got == {("AX21", "us"), ("X60", "us"), ("AX21", "pl")}
    assert {r[0] for r in probe_regions(spark.createDataFrame([(c,) for c in "edcba"], "region string")).collect()} == set("abcd")


def test_fetch_policies(spark):
    calls, waits = [], []

    def transport(method, url, spec):
        calls.append(url)
        if len(calls) == 1:
            raise TimeoutError
        return (503, {"Retry-After": "9"}, "", url) if len(calls) == 2 else (200, {}, "ok", url)

    r = fetch.fetch_one("u", SourceSpec("x", honours_retry_after=True), transport, waits.append)
    assert (r["status"], r["error"], len(calls), waits) == (200, None, 3, [2.0, 9.0])
    assert fetch.wait_seconds({}, 2, SPECS["wayback"]) == 8
    asked = spark.createDataFrame([(f"u{i}",) for i in range(40)], "request_url string")

    def down(method, url, spec):
        raise OSError

    broken = fetch.fetch(asked, SourceSpec("cc", retries=0, breaker=10, concurrency=5), down)
    assert broken.count() == 10
    blocked = fetch.fetch(asked, SourceSpec("f", retries=0, soft_block=(403,), concurrency=4), lambda m, u, s: (403, {}, "", u))
    assert blocked.count() == 4
    assert fetch.replay(asked, responses(spark, [("u1", 200, None, {}, "b", None)])).where("error = 'network'").count() == 39


def test_sources(spark):
    index = spark.createDataFrame([(0, 200, '<a href="?model=B"><a href="?model=A">'), (1, 200, '<a href="?model=A">'), (2, 404, '<a href="?model=C">')], "page int, status int, body string")
    assert [(r["model"], r["page"], r["pos"]) for r in pipelines.sister_models(index).orderBy("page", "pos").collect()] == [("B", 0, 0), ("A", 0, 1)]


def test_stream_equals_batch(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_text("http://h/a\nhttps://h/a\nhttps://h/b\n")
    for more in (None, "https://h/b\nhttps://h/c\n"):
        if more:
            (d / "b.txt").write_text(more)
        dedup.append(dedup.distinct_urls(dedup.url_stream(spark, str(d))), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r["url"] for r in readers.read_corpus(spark, str(d)).collect()) == ["https://h/a", "https://h/b", "https://h/c"]


def test_json_array_of_nothing(spark, tmp_path):
    sinks.write_json_array(spark.createDataFrame([], "url string"), str(tmp_path / "x.json"), "url")
    assert (tmp_path / "x.json").read_text() == "[]"


def test_cli_checks(capsys):
    assert cli.main([]) == 0 and "usage" in capsys.readouterr().out
    assert cli.main(["verify", "--data-dir", "../x"]) == 2 and cli.main(["bruteforce", "-c", "0"]) == 2


def test_existing_filters_by_no_long_expression(spark):
    """Nulls meet nothing, of equal times the greater status counts, and no filter or join works the keys out anew."""
    heads = spark.createDataFrame([("https://h/a", 200, 2), ("http://H/a", 404, 1), ("https://h/b", 200, 2), ("https://h/b", 404, 2), ("https://h/c", 200, 2), ("https://h/c", None, 2), ("https://h/d", 200, 1), ("https://h/d", 100, 2), ("https://h/e", 200, None), (None, 200, 3)], "request_url string, status int, at int")
    heads = heads.withColumn("fetched_at", F.timestamp_seconds("at")).drop("at")
    asked = spark.createDataFrame([("http://h/a",), ("https://h/b",), ("https://h/c",), ("https://h/d",), ("https://h/e",), (None,), ("",)], "url string")
    found = verify.existing(asked, heads)
    assert sorted(r["url"] for r in found.collect()) == ["http://h/a", "https://h/c", "https://h/e"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if ("Filter" in x or "Join" in x) and "regexp" in x]


def test_heads_of_names_are_made_once(spark, sf):
    """Each range of a sweep asks them; they are read, not made anew from all parts."""
    _, heads = queries.heads_of_names(spark, sf)
    plan = heads.where("request_url IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "p_name" not in plan and heads.count()
