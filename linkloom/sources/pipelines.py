"""What programs of sources share: rows of source and raw url of captured responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom import constants as C
from linkloom.operators import extract as X


def _rows(source: str, frame: DataFrame) -> DataFrame:
    return frame.select(F.lit(source).alias("source"), "url").where("url <> ''")


def code_search(pages: DataFrame, name: str = "github_search") -> DataFrame:
    return _rows(name, X.explode_urls(pages.where("status = 200"), X.code_search_urls(F.col("body"))))


def sister_models(index_pages: DataFrame) -> DataFrame:
    """index_pages: page (the order), body. Each model where it is first linked."""
    found = index_pages.where("status = 200").select("page", F.posexplode(X.index_models(F.col("body"))).alias("pos", "model"))
    return found.groupBy("model").agg(F.min(F.struct("page", "pos")).alias("at")).select("model", "at.page", "at.pos")


def forum_listing(pages: DataFrame) -> DataFrame:
    return _rows("reddit", X.explode_urls(pages.where("status = 200"), X.listing_urls(F.col("body"))))


def forums(discourse_pages: DataFrame, dork_pages: DataFrame) -> DataFrame:
    return _rows("forums", X.explode_urls(discourse_pages.where("status = 200"), X.discourse_urls(F.col("body"))).union(X.search_page_urls(dork_pages, False).select("url")))


def search_pages(pages: DataFrame) -> DataFrame:
    return _rows("google", X.search_page_urls(pages, True).select("url"))
