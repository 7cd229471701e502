"""Sources as programs, requests that are sent once, runs and command line over captured responses."""

import json
import threading
import time
from dataclasses import replace
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from linkloom import cli
from linkloom.functions.urls import origin_url, regional_url
from linkloom.operators import generate, verify
from linkloom.plans import sinks
from linkloom.plans.runs import BruteforceRun, ScrapeRun, VerifyRun
from linkloom.sources import fetch, readers, scrape
from linkloom.sources.spec import SPECS

HOST = "https://static.tp-link.com"
RESPONSES = "request_url string, status int, error string, headers map<string,string>, body string, final_url string, fetched_at timestamp"


def test_heads_are_sent_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def transport(method, url, spec):
        with open(log, "a") as f:
            f.write(f"{method} {url}\n")
        if url == f"https://s3.amazonaws.com/static.tp-link.com/7":
            return 301, {"X-Amz-Bucket-Region": "eu-1"}, "", url
        return 200, {"Content-Length": "3"}, "", url

    urls = spark.createDataFrame([(f"{HOST}/{i}",) for i in range(10)], "url string")
    got = fetch.verify_heads(urls, SPECS["verify"], transport, origin_url, regional_url)
    out = verify.classified(urls, got)
    assert out.where("live").count() == out.count() == 10 and got.count() == 10
    sent = open(log).read().split("\n")[:-1]
    assert len(sent) == len(set(sent)) == 11 and "HEAD https://s3.eu-1.amazonaws.com/static.tp-link.com/7" in sent


def test_of_two_responses_the_latest_counts(spark):
    rows = [("u", 404, "2024-01-01"), ("u", 200, "2024-01-02"), ("v", 200, None), ("v", 500, "2024-01-01"), ("w", None, None)]
    r = spark.createDataFrame(rows, "request_url string, status int, at string").select("request_url", "status", F.lit(None).cast("string").alias("error"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit("").alias("body"), F.lit("").alias("final_url"), F.to_timestamp("at").alias("fetched_at"))
    urls = spark.createDataFrame([("u",), ("v",), ("w",), ("x",)], "url string")
    assert {(o["url"], o["live"], o["status"]) for o in verify.classified(urls, r).collect()} == {("u", True, 200), ("v", False, 500), ("w", False, None), ("x", False, None)}
    assert fetch.replay(urls.withColumnRenamed("url", "request_url"), r).count() == 4


def test_walks_end(spark):
    first = spark.createDataFrame([("p0",)], "request_url string")
    ask = lambda asked: asked.withColumn("n", F.expr("int(substring(request_url, 2))"))
    follow = lambda pages: pages.where("n < 5").select(F.concat(F.lit("p"), (F.col("n") + 1).cast("string")).alias("request_url"))
    assert sorted(r["n"] for r in scrape.walk(first, ask, follow).collect()) == [0, 1, 2, 3, 4, 5]
    assert scrape.walk(first, ask, follow, 3).count() == 3
    assert scrape.walk(first.limit(0), ask, follow).count() == 0


def test_without_a_token_nothing_is_asked(spark):
    asked = []

    def ask(requests):
        asked.extend(r["request_url"] for r in requests.collect())
        return fetch.replay(requests, spark.createDataFrame([], RESPONSES))

    assert scrape.CodeSearch().run(spark, ask).count() == 0 and scrape.Organisation().run(spark, ask).count() == 0
    assert asked == []
    assert isinstance(scrape.Wayback(), scrape.Source) and [s.name for s in scrape.sources()][0] == "regional_crawl" and len(scrape.sources()) == 9


def captured(spark, tmp_path):
    tree = 'var productTree = {"1":[{"href":"%s/a_GPL.zip"},{"href":"?model=AX","app_folder":"us"}]};' % HOST
    rows = [
        ("https://www.tp-link.com/de/support/gpl-code/", 200, tree),
        ("https://www.tp-link.com/phppage/gpl-res-list.html?model=AX&appPath=us", 200, f'<a href="{HOST}/b_GPL.zip">'),
        ("https://www.google.com/search?q=site%3Astatic.tp-link.com+zip&num=10", 200, f"see {HOST}/c_gpl.zip."),
        ("https://www.tp-link.com/phppage/gpl-res-list.html?model=AX21&appPath=us", 200, f'<a href="{HOST}/AX21_GPL.zip">'),
        (f"{HOST}/a_GPL.zip", 200, ""),
    ]
    path = str(tmp_path / "responses")
    spark.createDataFrame([(u, s, None, {"Content-Length": "5"}, b, "", None) for u, s, b in rows], RESPONSES).write.parquet(path)
    return path


def test_command_line_end_to_end(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.delenv("GITHUB_TOKEN", raising=False)
    monkeypatch.setattr(cli, "session", lambda: spark)
    responses, data = captured(spark, tmp_path), str(tmp_path / "data")
    (tmp_path / "data" / "scrapes" / "seed").mkdir(parents=True)
    (tmp_path / "data" / "scrapes" / "seed" / "s.txt").write_text(f"{HOST}/x/AX21_GPL.zip\n")
    assert cli.main(["scrape", "--data-dir", data, "--responses", responses, "--model-sweep", "--sweep-max-models", "5"]) == 0
    out = capsys.readouterr().out
    assert "Regions scraped:      1" in out and "Pass 2 URLs:          1" in out and "Regional crawl URLs:  2 unique (2 raw)" in out
    assert "GitHub search URLs:  skipped (no GITHUB_TOKEN)" in out and "Google URLs:  1 unique (1 raw)" in out and "Wayback CDX URLs:  0 unique (0 raw)" in out
    assert "Model-sweep URLs:" in out and "failed\n" not in out.replace("Regions failed:", "")
    assert cli.main(["verify", "--data-dir", data, "--responses", responses, "-c", "3"]) == 0
    assert "Live:                 1" in capsys.readouterr().out
    assert cli.main(["bruteforce", "--data-dir", data, "--responses", responses, "--strategy", "models"]) == 0
    out = capsys.readouterr().out
    assert "Strategy:             models" in out and "Hits (date paths):    0" in out


def test_hit_files_are_there_and_a_bad_listing_does_not_stop_the_run(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{}")
    (tmp_path / "c.txt").write_text(f"{HOST}/upload/gpl-code/2024/202401/20240101/x_GPL.zip\n")
    hit = f"{HOST}/upload/gpl-code/2024/202401/20240102/x_GPL_v2.zip"
    responses = spark.createDataFrame([(hit, 200, None, {}, None, None, None)], RESPONSES)
    run = BruteforceRun(spark, str(tmp_path), responses, str(tmp_path / "bad.json"), str(tmp_path / "c.txt"), start="2024-01-01", end="2024-01-03")
    out = run.run()
    assert run.warnings and out["hits_dates"] == 1 and out["hits_models"] == 0 and out["errors"] == 0 and out["candidates_checked"] == 3 * 2 * 5
    assert open(f"{out['run_dir']}/bruteforce_dates.txt").read() == hit + "\n" and open(f"{out['run_dir']}/bruteforce_models.txt").read() == ""
    back = {(r["value"], r["source"]) for r in readers.scrape_lines(spark, f"{tmp_path}/scrapes").collect()}
    assert back == {(hit, "bruteforce_dates")}


def test_capped_candidates_come_in_order_and_are_not_enumerated(spark):
    names = spark.range(50).selectExpr("concat('n', lpad(id, 2, '0'), '.zip') AS basename")
    models = spark.range(1000).selectExpr("concat('M', lpad(id, 4, '0')) AS model")
    patterns = spark.createDataFrame([("GPL_{model}",), ("{model}_GPL",)], "pattern string")
    dirs = spark.createDataFrame([("/b/",), ("/a/",)], "date_path string")
    days = {"start": "2021-01-01", "end": "2021-01-02"}
    in_order = lambda rows: [tuple(r)[1:] for r in sorted(rows.select("ordinal", "strategy", "url").collect())]
    plan = generate.plan_candidates(spark, "all", names, models, patterns, dirs, **days)
    root = f"{HOST}/upload/gpl-code/2021/202101/20210101/"
    assert [u for _, u in in_order(plan.slice(0, 7))] == [f"{root}n00{v}.zip" for v in ("", "_2", "_3", "_v2", "V2")] + [f"{root}n01.zip", f"{root}n01_2.zip"]
    every = 50 * 5 * 4
    sides = (spark, "all", names, models, patterns, dirs, "thorough")
    plan = generate.plan_candidates(*sides, **days)
    assert in_order(plan.slice(every, every + 3)) == [("models", f"{HOST}/{d}/GPL_M0000.tar.{e}") for d, e in (("a", "gz"), ("b", "gz"), ("a", "bz2"))]
    got = {tuple(r) for r in generate.candidates(*sides, **days, cap=every + 3).collect()}
    assert len(got) == every + 3 and got == set(in_order(plan.slice(0, every + 3)))
    lazy = generate.date_candidates(names, generate.date_paths(spark, "2021-01-01", "2021-01-02"))
    assert {u for s, u in got if s == "dates"} == {r["url"] for r in lazy.collect()}
    assert generate.candidate_counts(*sides, start="2021-01-01", end="2021-01-02", cap=every + 3) == {"dates": every, "models": 3}
    assert generate.candidate_counts(*sides, start="2021-01-01", end="2021-01-02") == {"dates": every, "models": 1000 * 2 * 8 * 2}
    assert generate.candidates(*sides, start="2021-01-01", end="2021-01-02", cap=0).count() == 0


def test_candidates_by_ordinal_need_no_sort_and_no_limit(spark):
    names = spark.range(40).selectExpr("concat('n', lpad(id, 2, '0'), '.zip') AS basename")
    models = spark.range(30).selectExpr("concat('M', lpad(id, 2, '0')) AS model")
    patterns, dirs = spark.createDataFrame([("GPL_{model}",), ("{model}_GPL",)], "pattern string"), spark.createDataFrame([], "date_path string")
    plan = generate.plan_candidates(spark, "all", names, models, patterns, dirs, "exhaustive", start="2024-02-28", end="2024-03-01")
    whole = {r["ordinal"]: (r["strategy"], r["url"]) for r in plan.slice().collect()}
    assert sorted(whole) == list(range(plan.size)) and plan.size == 3 * 2 * 40 * 5 + 30 * 2 * 8 * 3 * 2 and len(set(whole.values())) == plan.size
    for few in (500_000, 35, 20, 0):  # sides that are broadcast, and sides that make their own ordinals
        parts = generate.Candidates(tuple((n, replace(s, broadcast_values=few)) for n, s in plan.parts))
        cuts = [0, 1, 777, 1200, 1203, 3000, plan.size + 5]
        shards = [{r["ordinal"]: (r["strategy"], r["url"]) for r in parts.slice(a, b).collect()} for a, b in zip(cuts, cuts[1:])]
        assert {k: v for s in shards for k, v in s.items()} == whole and sum(map(len, shards)) == plan.size
        text = parts.slice(100, 1300)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in text for word in ("TakeOrdered", "GlobalLimit", "CollectLimit"))
        assert few < 40 or "Sort" not in text


class Origin:
    """Answers of the origin, and a log of what it was asked for; it fails at the given request of a batch."""

    def __init__(self, log, live, fail_at=None):
        self.log, self.live, self.fail_at, self.batches = log, live, fail_at, 0

    def __call__(self, asked):
        self.batches += 1
        if self.batches == self.fail_at:
            raise RuntimeError("the cluster is gone")
        log, live = self.log, self.live

        def transport(method, url, spec):
            with open(log, "a") as f:
                f.write(f"{method} {url}\n")
            return (200 if url in live else 404), {}, "", url

        return fetch.fetch(asked, SPECS["bruteforce"], transport, 3)


def test_a_sweep_that_broke_is_taken_up_and_asks_nothing_twice(spark, tmp_path, monkeypatch):
    (tmp_path / "c.txt").write_text(f"{HOST}/upload/gpl-code/2024/202401/20240101/OC300%201_GPL.zip\n{HOST}/2024/202401/20240101/y_GPL.zip\n")
    origin = "https://s3.amazonaws.com/static.tp-link.com"
    live = {f"{origin}/2024/202401/20240102/OC300%201_GPL.zip", f"{origin}/upload/gpl-code/2024/202401/20240105/y_GPL_2.zip", f"{origin}/resources/gpl/GPL_AX.zip"}
    log, state = str(tmp_path / "log"), f"file://{tmp_path}/state"
    options = {"corpus": str(tmp_path / "c.txt"), "strategy": "dates", "start": "2024-01-01", "end": "2024-01-05", "state": state, "ranges": 5}
    data = f"file://{tmp_path}/data"
    with pytest.raises(Exception, match="the cluster is gone"):
        BruteforceRun(spark, data, ask=Origin(log, live, fail_at=3), **options).run()
    assert len(open(log).read().splitlines()) == 2 * 20 and list((tmp_path / "data/scrapes").rglob("*.txt"))  # hits so far are there
    (tmp_path / "c.txt").write_text(f"{HOST}/other_GPL.zip\n")  # what the sweep was prepared with counts
    broke = sinks.append_hits
    monkeypatch.setattr(sinks, "append_hits", lambda hits, folder, part=None: 1 if part == 3 else broke(hits, folder, part))
    with pytest.raises(Exception, match="could not be written"):
        BruteforceRun(spark, data, ask=Origin(log, live), **options).run()
    monkeypatch.setattr(sinks, "append_hits", broke)
    out = BruteforceRun(spark, data, ask=Origin(log, live), **options).run()
    asked = open(log).read().splitlines()
    assert len(asked) == len(set(asked)) == out["candidates_checked"] == 5 * 2 * 2 * 5 and all(a.startswith(f"HEAD {origin}/") for a in asked)
    assert (out["hits_dates"], out["hits_models"], out["errors"]) == (2, 0, 0)
    folder = out["run_dir"].removeprefix("file://")
    assert open(f"{folder}/bruteforce_dates.txt").read() == f"{HOST}/2024/202401/20240102/OC300%201_GPL.zip\n{HOST}/upload/gpl-code/2024/202401/20240105/y_GPL_2.zip\n"
    assert sorted(p.name for p in (tmp_path / "data/scrapes").rglob("*.txt")) == ["bruteforce_dates.txt", "bruteforce_models.txt"]
    again = BruteforceRun(spark, data, ask=Origin(log, live), **options).run()
    assert again == out and open(log).read().splitlines() == asked


def test_hits_by_the_address_that_was_asked(spark):
    url = f"{HOST}/upload/gpl-code/OC300 1_GPL.zip"
    candidates = spark.createDataFrame([(url,), (f"{HOST}/gone",)], "url string")
    for captured_as in (f"{HOST}/upload/gpl-code/OC300%201_GPL.zip", "https://s3.amazonaws.com/static.tp-link.com/upload/gpl-code/OC300%201_GPL.zip", url):
        rows = [(captured_as, 200, "2024-01-02"), (captured_as, 404, "2024-01-01"), (f"{HOST}/gone", 200, "2024-01-01"), (f"{HOST}/gone", 404, "2024-02-01")]
        heads = spark.createDataFrame(rows, "request_url string, status int, at string").withColumn("fetched_at", F.to_timestamp("at"))
        assert [r["url"] for r in verify.existing(candidates, heads).collect()] == [url]


def test_each_request_goes_by_its_policy(spark, tmp_path):
    log = str(tmp_path / "log")

    def transport(method, url, spec, headers=None):
        with open(log, "a") as f:
            f.write(json.dumps([spec.name, url, headers]) + "\n")
        body = 'var productTree = {"1":[{"href":"?model=AX","app_folder":"de"}]};' if "/de/support" in url and "tp-link" in url else '<a href="?model=M9">' if "mercusys" in url else ""
        return 200, {}, body, url

    asks = {name: fetch.Asking(SPECS[policy], transport) for name, policy in cli.POLICIES.items()}
    none = spark.createDataFrame([("AX21",)], "model string")
    for source in (scrape.Regional(("de", "fr"), discover=False), scrape.Sister(("en",)), scrape.Forums(), scrape.ModelSweep(none, ("us", "de"))):
        source.run(spark, asks[source.name]).count()
    sent = [json.loads(line) for line in open(log)]
    by = lambda text: {(p, (h or {}).get("Referer")) for p, u, h in sent if text in u}
    page = "https://www.tp-link.com/{}/support/gpl-code/".format
    assert by("fr/support/gpl-code/") == {("regional", None)} and by("model=AX&appPath=de") == {("model_page", page("de")), ("model_sweep", page("de"))}
    assert by("model=AX21&appPath=us") == {("model_sweep", page("us"))} and by("us/support/gpl-code/") == {("linked_page", None)}
    assert by("mercusys.com/en/support/gpl-code/?model=M9") == {("sister_model", None)} and by("site%3A") == {("dork", None)} and by("openwrt") == {("discourse", None)}


def test_connections_are_kept_and_limits_of_time_hold():
    """A server that counts connections, closes some, redirects, and keeps silent."""
    connections = []

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def setup(self):
            connections.append(self.client_address)
            super().setup()

        def do_GET(self):
            if self.path == "/slow":
                time.sleep(1)
            body = f"{self.path} {self.headers.get('Referer')}".encode()
            self.send_response(302 if self.path in ("/moved", "/loop") else 200)
            if self.path in ("/moved", "/loop"):
                self.send_header("Location", "/there?x=1" if self.path == "/moved" else "/loop")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(b"" if self.command == "HEAD" else body)
            self.close_connection = self.path == "/last"

        do_HEAD = do_GET
        log_message = lambda *_: None

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base, spec = f"http://127.0.0.1:{server.server_port}", SPECS["model_page"]
        for i in range(5):
            assert fetch.http_transport("GET", f"{base}/{i}?q", spec, {"Referer": "r"})[::2] == (200, f"/{i}?q r")
        assert fetch.http_transport("HEAD", f"{base}/h", spec)[2] == "" and len(connections) == 1
        assert fetch.http_transport("GET", f"{base}/last", spec)[0] == 200 and fetch.http_transport("GET", f"{base}/next", spec)[0] == 200 and len(connections) == 2
        assert fetch.http_transport("GET", f"{base}/moved", spec)[0] == 302
        follows = replace(spec, follow_redirects=True)
        assert fetch.http_transport("GET", f"{base}/moved", follows)[2:] == ("/there?x=1 None", f"{base}/there?x=1")
        assert fetch.fetch_one(f"{base}/loop", follows, fetch.http_transport)["error"] == "network"
        hasty = replace(spec, timeouts_s=spec.timeouts_s | {"read": 0.1})
        assert fetch.fetch_one(f"{base}/slow", hasty, fetch.http_transport)["error"] == "timeout" and fetch.http_transport("GET", f"{base}/after", spec)[0] == 200
    finally:
        server.shutdown()


def test_breakers_are_apart(spark, tmp_path):
    """One index that is down does not end the others; requests of an index share a task."""
    asked = spark.range(90).selectExpr("concat('https://i', id % 3, '/', id) AS request_url", "concat('i', id % 3) AS index")

    def transport(method, url, spec):
        if "//i1/" in url:
            raise TimeoutError
        return 200, {}, "", url

    policy = replace(SPECS["common_crawl"], jitter_s=(0.0, 0.0), retries=0, concurrency=5)
    got = {r["index"]: r["n"] for r in fetch.Asking(policy, transport)(asked).groupBy("index").agg(F.count_if(F.col("fetched_at").isNotNull()).alias("n")).collect()}
    assert got == {"i0": 30, "i1": 10, "i2": 30}


def test_a_resume_key_that_repeats_ends_the_walk(spark):
    def ask(asked):
        return asked.withColumn("status", F.lit(200)).withColumn("body", F.lit('["original"]\n["u"]\n[]\n["k"]'))

    assert scrape.Wayback().run(spark, ask).count() == 2 * 4


def test_a_search_that_is_cut_is_told(spark):
    pages = spark.createDataFrame([("q", "/e", 1, 200, '{"total_count": 1001, "items": []}'), ("r", "/e", 1, 200, '{"total_count": 1000}'), ("s", "/e", 2, 200, '{"total_count": 5000}'), ("t", "/e", 1, 500, '{"total_count": 5000}'), ("u", "/e", 1, 200, "bad")], "query string, endpoint string, page int, status int, body string")
    assert [tuple(r) for r in scrape.cut_queries(pages).collect()] == [("q", "/e", 1001)]


@pytest.mark.parametrize("url", ["https://h/with a space", "no-scheme", "http://[::1", "https://h:port/", "https://h/\x00", ""])
def test_no_url_ends_a_run(url):
    r = fetch.fetch_one(url, replace(SPECS["verify"], timeouts_s={"connect": 0.01, "write": 0.01, "read": 0.01}), fetch.http_transport, lambda s: None)
    assert r["status"] is None and r["error"] in ("network", "timeout")


def test_a_file_is_joined_from_pieces_of_any_number(spark, tmp_path):
    rows = [(f"https://h/{i:03d}", i if i % 7 else None, "é\u2028\"😀\n\x1f/" if i % 3 else None) for i in range(200)]
    frame = spark.createDataFrame(rows, "url string, n long, t string").repartition(7)
    for n, wanted in ((200, rows), (1, rows[:1]), (0, [])):
        few = frame.where(F.col("url") < f"https://h/{n:03d}")
        sinks.write_json_array(few, f"file://{tmp_path}/deep/{n}.json", "url")
        assert open(tmp_path / f"deep/{n}.json").read() == json.dumps([{"url": u, "n": k, "t": t} for u, k, t in wanted], indent=2)
        sinks.write_lines(few, f"file://{tmp_path}/deep/{n}.txt")
        assert open(tmp_path / f"deep/{n}.txt").read() == "".join(f"{u}\n" for u, *_ in wanted)
    sinks.write_lines(frame.limit(0), f"file://{tmp_path}/deep/200.txt")
    assert open(tmp_path / "deep/200.txt").read() == "" and sorted(p.name for p in (tmp_path / "deep").iterdir()) == ["0.json", "0.txt", "1.json", "1.txt", "200.json", "200.txt"]


def test_listing_by_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"key": "firmware/a", "size": 3}\nbad\n{"key": 5}\n{"key": "b"}\n')
    assert sorted((r["key"], r["size"]) for r in readers.firmware_listing(spark, str(tmp_path / "l.jsonl")).collect()) == [("b", 0), ("firmware/a", 3)]


def test_verify_writes_tables(spark, tmp_path):
    d = tmp_path / "scrapes" / "seed"
    d.mkdir(parents=True)
    (d / "a.txt").write_text(f"{HOST}/a_GPL.zip\n{HOST}/b_GPL.zip\n")
    responses = spark.createDataFrame([(f"{HOST}/a_GPL.zip", 200, None, {}, None, None, None)], RESPONSES)
    assert VerifyRun(spark, str(tmp_path), responses, tables=True).run()["live"] == 1
    assert [r["url"] for r in spark.read.parquet(str(tmp_path / "verified")).collect()] == [f"{HOST}/a_GPL.zip"] and spark.read.parquet(str(tmp_path / "dead")).count() == 1
    assert spark.read.parquet(str(tmp_path / "manifest")).first()["line"].startswith("cp ")


def test_a_failing_source_does_not_stop_the_run(spark, tmp_path):
    class Broken:
        name = "broken"

        def run(self, spark, ask):
            raise KeyError("no")

    run = ScrapeRun(spark, str(tmp_path), [Broken(), scrape.WebSearch()], partial(fetch.replay, responses=spark.createDataFrame([], RESPONSES)))
    out = run.run()
    assert out["sources_failed"] == ["broken"] and run.per_source_counts == {"google": (0, 0)} and open(f"{out['run_dir']}/google.txt").read() == ""


def test_inputs_are_sought_in_the_data_folders(spark, tmp_path):
    for folder, name in (("a", "x.json"), ("b", "x.json"), ("b", "s/y.txt")):
        (tmp_path / folder / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text("")
    paths = readers.DataPaths((str(tmp_path / "a"), f"file://{tmp_path}/b/"))
    assert paths.resolve(spark, "x.json") == f"{tmp_path}/a/x.json" and paths.resolve(spark, "s/y.txt") == f"file://{tmp_path}/b/s/y.txt"
    assert paths.resolve(spark, "z") is None and paths.given_or(spark, None, "z") is None
    assert paths.given_or(spark, f"{tmp_path}/b/x.json", "z") == f"{tmp_path}/b/x.json"
    assert paths.given_or(spark, "elsewhere/x.json", "z") == f"{tmp_path}/a/x.json" and paths.given_or(spark, "elsewhere/z", "x.json") == "elsewhere/z"
