"""The three runs as plans: scrape, verify, bruteforce."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.tokens import corpus_patterns, firmware_models
from linkloom.functions.urls import canonical, is_archive
from linkloom.operators import generate, verify
from linkloom.plans import sinks
from linkloom.plans.durable import DurableSweep
from linkloom.session import stored
from linkloom.sources import readers
from linkloom.sources.scrape import Ask, Source


@dataclass
class VerifyRun:
    """Read all lists, canonicalize, gate, look up, split, write, count. tables: results are written as tables by all tasks,
    in place of single files by the driver."""

    spark: SparkSession
    data_dir: str
    responses: DataFrame
    tables: bool = False

    def outcomes(self) -> DataFrame:
        corpus = readers.read_corpus(self.spark, f"{self.data_dir}/scrapes").where(is_archive(F.col("url")))
        return verify.classified(corpus, self.responses)

    def run(self) -> dict:
        found = self.outcomes().persist()
        try:
            write = sinks.write_verify_tables if self.tables else sinks.write_verify_outputs
            write(verify.verified(found), verify.dead(found), self.data_dir)
            return verify.run_stats(found).first().asDict()
        finally:
            found.unpersist()


@dataclass
class ScrapeRun:
    """sources: programs that ask() (or the one of their name) answers, or frames of raw urls by name. A source that fails writes no file and does not
    stop the others."""

    spark: SparkSession
    data_dir: str
    sources: dict[str, DataFrame] | list[Source]
    ask: Ask | dict[str, Ask] | None = None
    per_source_counts: dict[str, tuple[int, int]] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def run(self) -> dict:
        folder = f"{self.data_dir}/scrapes/{sinks.run_id()}"
        passes = {"regions_scraped": 0, "regions_failed": 0, "pass1_urls": 0, "pass2_urls": 0}
        for source in self.sources:
            name = source if isinstance(source, str) else source.name
            try:
                frame = self.sources[name] if isinstance(source, str) else source.run(self.spark, self.ask[name] if isinstance(self.ask, dict) else self.ask)
                rows = frame.select("url", canonical(F.col("url")).alias("canonical")).persist()
                n = rows.agg(F.count_distinct("url").alias("raw"), F.count_distinct(F.when(F.col("canonical") != "", F.col("canonical"))).alias("unique")).first()
                sinks.write_lines(rows.where("canonical <> ''").select(F.col("canonical").alias("url")).distinct(), f"{folder}/{name}.txt")
                self.per_source_counts[name] = n["raw"], n["unique"]
                passes |= getattr(source, "counts", {})
                self.warnings += [f"{name}: {q!r} has more hits than the search shows; split it" for q in getattr(source, "cut", [])]
                rows.unpersist()
            except Exception as e:  # noqa: BLE001  one source's failure is its own
                self.failed[name] = str(e)
        raw, unique = (sum(c[i] for c in self.per_source_counts.values()) for i in (0, 1))
        return passes | {"raw_count": raw, "unique_count": unique, "run_dir": folder, "sources_failed": sorted(self.failed)}


@dataclass
class BruteforceRun:
    """Generate, cap, look up, write hits. A dry run only counts what would be asked. With ask, requests are sent by a durable
    sweep whose state is in the folder `state`; a run that is given the folder of one that broke takes it up."""

    spark: SparkSession
    data_dir: str
    responses: DataFrame | None = None
    listing: str | None = None
    corpus: str | None = None
    strategy: str = "all"
    tier: str = "default"
    max_candidates: int | None = None
    dry_run: bool = False
    start: str | None = None
    end: str | None = None
    ask: Ask | None = None
    state: str | None = None
    ranges: int | None = None
    warnings: list[str] = field(default_factory=list)

    def listed_models(self) -> DataFrame:
        """Of the firmware listing; none, with a warning, if it is missing or malformed."""
        none = self.spark.createDataFrame([], "model string")
        if not self.listing:
            return none
        try:
            return stored(readers.firmware_listing(self.spark, self.listing).select(F.explode(firmware_models(F.col("key"))).alias("model")).distinct(), "models")
        except (ValueError, AnalysisException) as e:
            self.warnings.append(f"firmware listing not used: {e}")
            return none

    def sides(self) -> tuple[DataFrame, ...]:
        names, dirs = readers.known_corpus(self.spark, self.corpus)
        return names, self.listed_models(), corpus_patterns(names), dirs

    def run(self) -> dict:
        days = {k: v for k, v in (("start", self.start), ("end", self.end)) if v}
        out = {"strategy": self.strategy, "tier": self.tier, "dry_run": self.dry_run, "hits_dates": 0, "hits_models": 0, "errors": 0}
        if self.ask is not None and not self.dry_run:
            folder = self.state or f"{self.data_dir}/bruteforce/{sinks.run_id()}"
            sweep = DurableSweep(self.spark, folder, self.data_dir, self.ask)
            plan = sweep.prepare(self.strategy, *self.sides(), self.tier, cap=self.max_candidates, ranges=self.ranges, **days)
            return out | sweep.run(plan)
        plan = generate.plan_candidates(self.spark, self.strategy, *self.sides(), self.tier, **days)
        n = sum(plan.counts(self.max_candidates).values())
        if self.dry_run or self.responses is None:
            return out | {"candidates_checked": 0, "candidates_enumerated": n, "run_dir": None}
        folder = f"{self.data_dir}/scrapes/{sinks.run_id()}"
        found = verify.existing(plan.slice(0, self.max_candidates), self.responses)
        hits = stored(found.select("strategy", canonical(F.col("url")).alias("url")), "hits")
        out["errors"] = sinks.append_hits(hits, folder)
        for r in hits.groupBy("strategy").count().collect():
            out[f"hits_{r['strategy']}"] = r["count"]
        return out | {"candidates_checked": n, "run_dir": folder}
