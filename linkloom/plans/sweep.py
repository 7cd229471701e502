"""The model sweep: probe few regions, harvest siblings once, expand what answered to the other regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom import constants as C
from linkloom.functions.tokens import archive_tokens
from linkloom.operators.extract import href_urls


def probe_regions(regions: DataFrame, wanted=None) -> DataFrame:
    """The wanted ones that are known, or the first four if none is."""
    wanted = C.PROBE_REGIONS if wanted is None else wanted
    known = regions.where(F.col("region").isin(*wanted))
    none = known.agg((F.count("*") == 0).alias("none"))
    first = regions.orderBy("region").limit(4).crossJoin(F.broadcast(none)).where("none").select("region")
    return known.select("region").union(first)


def lookup(models: DataFrame, regions: DataFrame, responses) -> DataFrame:
    """model, region, url found for each model in each region; names match whatever their case. responses: a table of them,
    or what answers requests (model, region)."""
    asked = models.select("model", F.lower("model").alias("k")).crossJoin(F.broadcast(regions.select("region")))
    if callable(responses):
        return responses(asked.drop("k")).where("status = 200").select("model", "region", F.explode(href_urls(F.col("body"))).alias("url"))
    pages = responses.where("status = 200").select(F.lower("model").alias("k"), "region", "body")
    return asked.join(pages, ["k", "region"]).select("model", "region", F.explode(href_urls(F.col("body"))).alias("url"))


def sweep(seed: DataFrame, linked: DataFrame, regions: DataFrame, responses, probe=None, max_models: int | None = None) -> DataFrame:
    """model, region, url of all phases. Exactly one round of siblings is harvested."""
    models = seed.select("model").union(linked.select("model")).distinct()
    if max_models is not None:
        models = models.orderBy("model").limit(max_models)
    near = probe_regions(regions, probe)
    first = lookup(models, near, responses)
    siblings = first.select(F.explode(archive_tokens(F.col("url"))).alias("model")).distinct().join(models, "model", "left_anti")
    probed = first.union(lookup(siblings, near, responses))
    good = probed.select("model").distinct()
    return probed.union(lookup(good, regions.join(near, "region", "left_anti"), responses)).distinct()
