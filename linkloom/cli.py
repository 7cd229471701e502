"""scrape | verify | bruteforce over captured responses."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import constants as C
from linkloom.functions.tokens import model_wordlist
from linkloom.functions.urls import is_archive, origin_url, regional_url
from linkloom.plans.runs import BruteforceRun, ScrapeRun, VerifyRun
from linkloom.session import session
from linkloom.sources import fetch, readers
from linkloom.sources.scrape import Ask, sources
from linkloom.sources.spec import SPECS

RESPONSES = "request_url string, status int, error string, headers map<string,string>, body string, final_url string, fetched_at timestamp"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linkloom")
    verbs = p.add_subparsers(dest="verb")
    for verb in ("verify", "scrape", "bruteforce"):
        v = verbs.add_parser(verb)
        v.add_argument("--data-dir", default="data")
        v.add_argument("--responses", help="Parquet table of captured responses")
        v.add_argument("--live", action="store_true", help="send requests, in place of captured responses")
    verbs.choices["verify"].add_argument("-c", "--concurrency", type=int, default=100)
    verbs.choices["scrape"].add_argument("--discoveries", help="Parquet table of source and url")
    verbs.choices["scrape"].add_argument("--listing", help="firmware listing, for the sweep")
    verbs.choices["scrape"].add_argument("--wikis", help="Parquet table of repository and body of wiki files")
    verbs.choices["scrape"].add_argument("--model-sweep", action="store_true")
    verbs.choices["scrape"].add_argument("--sweep-max-models", type=int)
    b = verbs.choices["bruteforce"]
    b.add_argument("-c", "--concurrency", type=int, default=100)
    b.add_argument("--strategy", choices=("dates", "models", "all"), default="all")
    b.add_argument("--thorough", action="store_true")
    b.add_argument("--exhaustive", action="store_true")
    b.add_argument("--max-candidates", type=int)
    b.add_argument("--dry-run", action="store_true")
    b.add_argument("--resume", metavar="FOLDER", help="take up a live run that broke, by the folder of its state")
    b.add_argument("--listing")
    b.add_argument("--corpus")
    return p


def check(args: argparse.Namespace) -> str | None:
    """What is wrong with the arguments."""
    if ".." in args.data_dir.split("/"):
        return "--data-dir must not contain '..'"
    if getattr(args, "concurrency", 1) < 1:
        return "--concurrency must be at least 1"
    return None


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.verb is None:
        p.print_help()
        return 0
    if wrong := check(args):
        print(wrong, file=sys.stderr)
        return 2
    spark = session()
    responses = spark.read.parquet(args.responses) if args.responses else spark.createDataFrame([], RESPONSES)
    for line in VERBS[args.verb](spark, args, responses):
        print(line)
    return 0


def verify(spark: SparkSession, args: argparse.Namespace, responses: DataFrame) -> list[str]:
    run = VerifyRun(spark, args.data_dir, responses)
    if args.live:  # ask for what the lists name, with so many requests open
        corpus = readers.read_corpus(spark, f"{args.data_dir}/scrapes").where(is_archive(F.col("url")))
        spec = replace(SPECS["verify"], concurrency=args.concurrency)
        run.responses = fetch.verify_heads(corpus, spec, fetch.http_transport, origin_url, regional_url)
    n = run.run()
    return ["Verify complete", *(f"  {label:<21} {n[k]}" for k, label in (("total_urls", "Total URLs:"), ("unique_urls", "Unique URLs:"), ("live", "Live:"), ("dead", "Dead:")))]


def scrape(spark: SparkSession, args: argparse.Namespace, responses: DataFrame) -> list[str]:
    token = os.environ.get("GITHUB_TOKEN")
    if args.discoveries:
        found = spark.read.parquet(args.discoveries).select("source", "url")
        names = [r[0] for r in found.select("source").distinct().collect()]  # one row for each source
        run = ScrapeRun(spark, args.data_dir, {n: found.where(found["source"] == n) for n in sorted(names)})
    else:
        models = None
        if args.model_sweep:
            path = readers.DataPaths().given_or(spark, args.listing, C.LISTING_FILE)
            listing = readers.firmware_listing(spark, path) if path else spark.createDataFrame([], "key string, size bigint")
            models = model_wordlist(listing, readers.read_corpus(spark, f"{args.data_dir}/scrapes"))
        run = ScrapeRun(spark, args.data_dir, sources(token, spark.read.parquet(args.wikis) if args.wikis else None, models, args.sweep_max_models), live_asks(token) if args.live else partial(fetch.replay, responses=responses))
    n = run.run()
    labels = (("regions_scraped", "Regions scraped:"), ("regions_failed", "Regions failed:"), ("pass1_urls", "Pass 1 URLs:"), ("pass2_urls", "Pass 2 URLs:"), ("raw_count", "Raw total:"), ("unique_count", "Unique (normalized):"))
    out = ["Scrape complete", *(f"  {label:<21} {n[k]}" for k, label in labels)]
    for w in run.warnings:
        print(f"warning: {w}", file=sys.stderr)
    for name, (raw, unique) in run.per_source_counts.items():
        skipped = name in ("github_search", "tplink_github") and not token and not raw
        out.append(f"  {C.SOURCE_LABELS.get(name, name)}:  " + ("skipped (no GITHUB_TOKEN)" if skipped else f"{unique} unique ({raw} raw)"))
    return out + [f"  {name} failed" for name in sorted(run.failed)]


#: The policy by which each source asks.
POLICIES = {
    "regional_crawl": "regional", "wayback_cdx": "wayback", "common_crawl": "common_crawl", "github_search": "code_search", "tplink_github": "organisation_search",
    "mercusys_regional": "sister_index", "reddit": "forum_listing", "forums": "discourse", "google": "search_pages", "model_sweep": "model_sweep",
}


def live_asks(token: str | None) -> dict[str, Ask]:
    signed = partial(fetch.http_transport, headers={"Authorization": f"Bearer {token}", "Accept": "application/vnd.github.text-match+json"})
    return {name: fetch.Asking(SPECS[policy], signed if "github" in name and token else fetch.http_transport) for name, policy in POLICIES.items()}


def bruteforce(spark: SparkSession, args: argparse.Namespace, responses: DataFrame) -> list[str]:
    tier = "exhaustive" if args.exhaustive else "thorough" if args.thorough else "default"
    if tier == "exhaustive" and args.max_candidates is None:
        print("warning: exhaustive without --max-candidates", file=sys.stderr)
    listing, corpus = (readers.DataPaths().given_or(spark, given, name) for given, name in ((args.listing, C.LISTING_FILE), (args.corpus, C.CORPUS_FILE)))
    run = BruteforceRun(spark, args.data_dir, responses if args.responses else None, listing, corpus, args.strategy, tier, args.max_candidates, args.dry_run)
    if (args.live or args.resume) and not args.dry_run:
        run.state, spec = args.resume, replace(SPECS["bruteforce"], concurrency=args.concurrency)
        run.ask = lambda asked: fetch.fetch(asked, spec, fetch.http_transport)
    n = run.run()
    labels = (("strategy", "Strategy:"), ("tier", "Tier:"), ("candidates_checked", "Candidates checked:"), ("hits_dates", "Hits (date paths):"), ("hits_models", "Hits (model names):"), ("errors", "Transport errors:"), ("run_dir", "Run dir:"))
    for w in run.warnings:
        print(f"warning: {w}", file=sys.stderr)
    return ["Bruteforce complete", *(f"  {label:<21} {n[k]}" for k, label in labels)]


VERBS = {"verify": verify, "scrape": scrape, "bruteforce": bruteforce}


if __name__ == "__main__":
    sys.exit(main())
