"""The sources as programs: what they ask for, page by page, and the URLs in the answers.

A source has a name and a run(spark, ask); ask answers requests (a frame with request_url, kept with its other columns)
from captured responses or by a transport. Walks follow cursors or page numbers: a round asks for the next page of all
endpoints at once, and ends where the source's rules say so.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import constants as C
from linkloom.operators import extract as X
from linkloom.operators import generate
from linkloom.plans.sweep import sweep
from linkloom.session import stored
from linkloom.sources import pipelines
from linkloom.sources.fetch import under
from linkloom.sources.spec import SPECS

Ask = Callable[[DataFrame], DataFrame]


@runtime_checkable
class Source(Protocol):
    """Anything with a name, which names its file, and a run that gives rows of source and raw url."""

    name: str

    def run(self, spark: SparkSession, ask: Ask) -> DataFrame: ...


def request(base: Column | str, **values: Column | str) -> Column:
    """A URL with its query, form-encoded."""
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    parts = [F.concat(F.lit(f"{k}="), F.url_encode(column(v))) for k, v in values.items()]
    return F.concat(column(base), F.lit("?"), F.concat_ws("&", *parts)) if parts else column(base)


def walk(first: DataFrame, ask: Ask, follow: Callable[[DataFrame], DataFrame], cap: int | None = None) -> DataFrame:
    """All pages: those asked for first, and what follow() asks for after each round of them, up to cap rounds.

    Each round is asked once and kept in the shared folder. An endpoint that answers nothing is not followed by itself:
    follow() gives no request for it.
    """
    pages, asked, n = stored(ask(first), "pages"), first, 1
    last = pages
    while cap is None or n < cap:
        asked = follow(last)
        if not asked.limit(1).count():
            break
        last, n = stored(ask(asked), "pages"), n + 1
        pages = pages.unionByName(last)
    return pages


def good(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("status") == 200)


@dataclass
class Regional:
    """Region pages, then the fragments that their pairs of model and folder name. discover: regions are sought first, and
    those given are asked for in any case."""

    regions: tuple[str, ...] = C.REGIONS
    discover: bool = True
    name: str = "regional_crawl"
    counts: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def page(region: Column) -> Column:
        before, after = C.REGION_PAGE.split("{region}")
        return F.concat(F.lit(before), region, F.lit(after))

    def found_regions(self, spark: SparkSession, ask: Ask) -> DataFrame:
        """Two-letter codes whose page has a product tree, those of the location picker, and the known ones."""
        codes = generate.region_codes(spark)
        live = generate.live_regions(codes, stored(ask(codes.withColumn("request_url", self.page(F.col("region")))), "codes"))
        picker = good(ask(spark.createDataFrame([(C.PICKER_URL,)], "request_url string")))
        picked = X.explode_urls(picker, X.picker_regions(F.col("body"))).select(F.col("url").alias("region"))
        return generate.all_regions(spark, live, picked)

    def run(self, spark: SparkSession, ask: Ask) -> DataFrame:
        regions = self.found_regions(spark, ask) if self.discover else generate.literals(spark, "region", self.regions)
        pages = stored(ask(regions.withColumn("request_url", self.page(F.col("region")))), "regions")
        rows = stored(X.region_page_rows(good(pages).select("region", "body")), "region-rows")
        pairs = rows.where("kind = 'pair'").select("model", "app_folder").distinct()
        asked = pairs.withColumn("request_url", request(C.MODEL_PAGE, model=F.col("model"), appPath=F.col("app_folder"))).withColumn("referer", self.page(F.col("app_folder")))
        fragments = stored(under(ask, "model_page")(asked).select(F.explode(X.href_urls(F.col("body"))).alias("url")), "fragments")
        direct = rows.where("url IS NOT NULL").select("url")
        self.counts = {"regions_scraped": good(pages).count(), "pass1_urls": direct.count(), "pass2_urls": fragments.count()}
        self.counts["regions_failed"] = pages.count() - self.counts["regions_scraped"]
        return direct.union(fragments).where("url <> ''").select(F.lit(self.name).alias("source"), "url")


@dataclass
class Wayback:
    """Pages of each prefix by resume key, until one fails, is empty or names no key or one that was there before."""

    name: str = "wayback_cdx"

    @staticmethod
    def url(key: Column | None = None) -> Column:
        fixed = {"url": F.col("prefix"), "output": "json", "fl": "original", "limit": "10000", "showResumeKey": "true"}
        return request(C.CDX_ENDPOINT, **fixed, **({} if key is None else {"resumeKey": key}))

    def run(self, spark: SparkSession, ask: Ask) -> DataFrame:
        first = generate.literals(spark, "prefix", C.CDX_PREFIXES).select("prefix", F.array().cast("array<string>").alias("seen"), self.url().alias("request_url"))

        def follow(pages: DataFrame) -> DataFrame:
            keys = good(pages).where(F.trim("body") != "").select("prefix", "seen", X.cdx_rows(F.trim("body"))["resume_key"].alias("key"))
            fresh = keys.where(F.col("key").isNotNull() & ~F.array_contains("seen", F.col("key")))
            return fresh.select("prefix", F.array_append("seen", F.col("key")).alias("seen"), self.url(F.col("key")).alias("request_url"))

        pages = walk(first, ask, follow)
        return X.explode_urls(good(pages), X.cdx_rows(F.trim("body"))["urls"]).select(F.lit(self.name).alias("source"), "url")


@dataclass
class CommonCrawl:
    """All indices of the listing by all prefixes: how many pages there are, then each of them; a bad page is passed over."""

    name: str = "common_crawl"

    def run(self, spark: SparkSession, ask: Ask) -> DataFrame:
        listing = good(ask(spark.createDataFrame([(C.CRAWL_LISTING,)], "request_url string")))
        indices = X.explode_urls(listing, X.crawl_indices(F.col("body"))).select(F.col("url").alias("index")).distinct()
        asked = indices.crossJoin(generate.literals(spark, "prefix", C.CRAWL_PREFIXES))
        sizes = good(stored(ask(asked.withColumn("request_url", request(F.col("index"), url=F.col("prefix"), showNumPages="true"))), "sizes"))
        pages = generate.crawl_pages(sizes.select("index", "prefix", F.get_json_object("body", "$.pages").try_cast("int").alias("pages")))
        url = request(F.col("index"), url=F.col("prefix"), output="json", page=F.col("page").cast("string"))
        return X.explode_urls(good(ask(pages.withColumn("request_url", url))), X.ndjson_urls(F.col("body"))).select(F.lit(self.name).alias("source"), "url")


def code_pages(asked: DataFrame, ask: Ask, cap: int | None) -> DataFrame:
    """asked: query, endpoint. Pages 1 to cap, until one fails or has no items."""
    url = request(F.concat(F.lit(C.CODE_HOST), F.col("endpoint")), q=F.col("query"), per_page="100", page=F.col("page").cast("string"))

    def follow(pages: DataFrame) -> DataFrame:
        more = good(pages).where(F.coalesce(F.json_array_length(F.get_json_object("body", "$.items")), F.lit(0)) > 0)
        return more.select("query", "endpoint", (F.col("page") + 1).alias("page")).withColumn("request_url", url)

    return walk(asked.withColumn("page", F.lit(1)).withColumn("request_url", url), ask, follow, cap)


def cut_queries(pages: DataFrame) -> DataFrame:
    """Queries and endpoints with more hits than the search gives pages of."""
    total = F.get_json_object("body", "$.total_count").try_cast("bigint")
    return good(pages).where((F.col("page") == 1) & (total > C.CODE_HITS)).select("query", "endpoint", total.alias("hits"))


@dataclass
class CodeSearch:
    """Queries by endpoints; without a token nothing is asked. cut: queries that have more hits than can be seen."""

    token: str | None = None
    name: str = "github_search"
    cut: list[str] = field(default_factory=list)

    def run(self, spark: SparkSession, ask: Ask) -> DataFrame:
        asked = generate.requests(spark, query=C.CODE_QUERIES, endpoint=C.CODE_ENDPOINTS)
        pages = code_pages(asked if self.token else asked.limit(0), ask, SPECS["code_search"].page_cap)
        self.cut = [r["query"] for r in cut_queries(pages).select("query").distinct().collect()]  # of the few queries there are
        return pipelines.code_search(pages, self.name)


@dataclass
class Organisation:
    """A search within the organisation, and the wikis of its repositories: those of the organisation's list, or if that
    fails of the user's. wikis: repository and body of wiki files, as cloned."""

    token: str | None = None
    wikis: DataFrame | None = None
    name: str = "tplink_github"

    def repositories(self, spark: SparkSession, ask: Ask) -> DataFrame:
        paths = spark.createDataFrame([(0, "orgs"), (1, "users")], "nth int, kind string")
        url = request(F.concat(F.lit(f"{C.CODE_HOST}/"), F.col("kind"), F.lit(f"/{C.ORGANISATION}/repos")), per_page="100")
        lists = good(ask(paths.withColumn("request_url", url))).where(F.ltrim("body").startswith("["))
        first = lists.agg(F.min_by("body", "nth").alias("body"))
        return first.select(F.explode(X.wiki_repositories(F.col("body"))).alias("repository"))

    def run(self, spark: SparkSession, ask: Ask) -> DataFrame:
        asked = generate.requests(spark, query=(C.ORGANISATION_QUERY,), endpoint=C.CODE_ENDPOINTS)
        found = pipelines.code_search(code_pages(asked if self.token else asked.limit(0), ask, SPECS["organisation_search"].page_cap), self.name)
        if self.wikis is None or not self.token:
            return found
        read = self.wikis.join(self.repositories(spark, ask), "repository", "left_semi")
        return found.union(X.explode_urls(read, X.wiki_urls(F.col("body"))).select(F.lit(self.name), "url"))


@dataclass
class Sister:
    """Index pages of the sample regions name models, each where it is first linked; a page for each model has the URLs."""

    regions: tuple[str, ...] = tuple(r for r in C.SISTER_SAMPLE if r in C.SISTER_REGIONS)
    name: str = "mercusys_regional"

    def run(self, spark: SparkSession, ask: Ask) -> DataFrame:
        index = spark.createDataFrame(list(enumerate(self.regions)), "page int, region string")
        url = F.concat(F.lit(f"{C.SISTER_SITE}/"), F.col("region"), F.lit("/support/gpl-code/"))
        models = pipelines.sister_models(stored(ask(index.withColumn("request_url", url)), "index")).select("model")
        asked = models.withColumn("request_url", F.concat(F.lit(f"{C.SISTER_SITE}/en/support/gpl-code/?model="), F.col("model")))
        return X.explode_urls(good(under(ask, "sister_model")(asked)), X.text_urls(F.col("body"), C.SISTER_URL)).select(F.lit(self.name).alias("source"), "url")


@dataclass
class Listings:
    """Searches of a forum listing, on the whole site and in some parts of it, by cursor: until one fails, has no entries,
    or names no cursor or one that was there before."""

    name: str = "reddit"

    def run(self, spark: SparkSession, ask: Ask) -> DataFrame:
        rest = {"limit": "100", "sort": "relevance", "t": "all"}
        site = [(f"{C.LISTING_HOST}/search.json", C.LISTING_QUERIES[0], None)]
        parts = [(f"{C.LISTING_HOST}/r/{s}/search.json", C.LISTING_QUERIES[1], "1") for s in C.SUBREDDITS]
        first = spark.createDataFrame([(*r, []) for r in site + parts], "endpoint string, query string, restrict string, seen array<string>")

        def url(after: bool) -> Column:
            more = {"after": F.element_at("seen", -1)} if after else {}
            whole = request(F.col("endpoint"), q=F.col("query"), **rest, **more)
            return F.when(F.col("restrict").isNull(), whole).otherwise(request(F.col("endpoint"), q=F.col("query"), restrict_sr=F.col("restrict"), **rest, **more))

        def follow(pages: DataFrame) -> DataFrame:
            more = good(pages).where(F.coalesce(F.json_array_length(F.get_json_object("body", "$.data.children")), F.lit(0)) > 0)
            more = more.withColumn("after", X.listing_cursor(F.col("body"))).where((F.col("after") != "") & ~F.array_contains("seen", F.col("after")))
            return more.select("endpoint", "query", "restrict", F.array_append("seen", F.col("after")).alias("seen")).withColumn("request_url", url(True))

        pages = walk(first.withColumn("request_url", url(False)), ask, follow, SPECS["forum_listing"].page_cap)
        return pipelines.forum_listing(pages).select(F.lit(self.name).alias("source"), "url")


@dataclass
class Forums:
    """A forum's search by page number while there are more posts, and searches of other forums through a web search."""

    name: str = "forums"

    def run(self, spark: SparkSession, ask: Ask) -> DataFrame:
        url = request(C.DISCOURSE_SEARCH, q=C.LISTING_QUERIES[0], page=F.col("page").cast("string"))

        def follow(pages: DataFrame) -> DataFrame:
            return good(pages).where(X.discourse_more(F.col("body"))).select((F.col("page") + 1).alias("page")).withColumn("request_url", url)

        pages = walk(spark.createDataFrame([(1,)], "page int").withColumn("request_url", url), ask, follow, SPECS["discourse"].page_cap)
        sites = generate.literals(spark, "site", C.DORK_DOMAINS)
        dork = request(C.WEB_SEARCH, q=F.concat(F.lit("site:"), F.col("site"), F.lit(f" {C.LISTING_QUERIES[0]}")), num="10")
        return pipelines.forums(pages, under(ask, "dork")(sites.withColumn("request_url", dork))).select(F.lit(self.name).alias("source"), "url")


@dataclass
class WebSearch:
    """One web search for each suffix of archives."""

    name: str = "google"

    def run(self, spark: SparkSession, ask: Ask) -> DataFrame:
        suffixes = generate.literals(spark, "suffix", C.CANDIDATE_EXTENSIONS)
        url = request(C.WEB_SEARCH, q=F.concat(F.lit(f"site:{C.ARCHIVE_HOST} "), F.col("suffix")), num="10")
        return pipelines.search_pages(ask(suffixes.withColumn("request_url", url))).select(F.lit(self.name).alias("source"), "url")


@dataclass
class ModelSweep:
    """Known models, and those that region pages link to, asked for in few regions; siblings once; then what answered in all
    others. Without regions these are discovered."""

    models: DataFrame
    regions: tuple[str, ...] | None = None
    max_models: int | None = None
    name: str = "model_sweep"
    counts: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, ask: Ask) -> DataFrame:
        def responses(asked: DataFrame) -> DataFrame:
            url = request(C.MODEL_PAGE, model=F.col("model"), appPath=F.col("region"))
            return stored(ask(asked.withColumn("request_url", url).withColumn("referer", Regional.page(F.col("region")))), "sweep")

        regions = generate.literals(spark, "region", self.regions) if self.regions else stored(Regional().found_regions(spark, under(ask, "regional")), "sweep-regions")
        pages = under(ask, "linked_page")(regions.withColumn("request_url", Regional.page(F.col("region"))))
        linked = X.explode_urls(good(pages), X.linked_models(F.col("body"))).select(F.col("url").alias("model")).distinct()
        found = stored(sweep(self.models, stored(linked, "linked"), regions, responses, max_models=self.max_models), "swept")
        self.counts = found.agg(F.count_distinct("model").alias("validated_models"), F.count_distinct("region").alias("verified_regions")).first().asDict()
        return found.select(F.lit(self.name).alias("source"), "url")


def sources(token: str | None = None, wikis: DataFrame | None = None, models: DataFrame | None = None, max_models: int | None = None) -> list[Source]:
    """All sources in their order; the sweep only where models are given."""
    out: list[Source] = [Regional(), Wayback(), CommonCrawl(), CodeSearch(token), Organisation(token, wikis), Sister(), Listings(), Forums(), WebSearch()]
    return out + ([ModelSweep(models, max_models=max_models)] if models is not None else [])


def everything(spark: SparkSession, ask: Ask, wanted: list[Source]) -> DataFrame:
    return reduce(DataFrame.unionByName, (s.run(spark, ask) for s in wanted))
