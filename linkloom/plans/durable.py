"""A sweep over candidates that survives its end: ranges of ordinals as a stream, each range's answers kept before they are used.

What the candidates are made of is frozen in the sweep's folder when it is prepared, so that an ordinal means the same URL
whenever the sweep is taken up again. Each range of ordinals is a file, and one batch of the stream. A batch asks for what
it has no answers of, keeps these, then writes its hits, both under its own number, so a batch that runs again overwrites
itself and asks nothing anew. What may be asked twice is the range whose answers were not yet kept when the sweep broke.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import constants as C
from linkloom.functions.urls import at_origin, canonical
from linkloom.operators.generate import Candidates, plan_candidates
from linkloom.plans import sinks

#: Candidates of a range, unless a number of ranges is given.
RANGE = 1_000_000
SIDES = {"basenames": "basename", "models": "model", "patterns": "pattern", "known_dirs": "date_path"}


@dataclass
class DurableSweep:
    """folder: of the sweep's state, in a file system that driver and executors share. data_dir: where runs lie. ask: from
    request_url to status (null: no answer, which is a miss), for instance by sending HEADs."""

    spark: SparkSession
    folder: str
    data_dir: str
    ask: Callable[[DataFrame], DataFrame]

    def _settings(self) -> dict | None:
        path = f"{self.folder}/settings"
        return json.loads(self.spark.read.text(path).first()["value"]) if sinks.exists(self.spark, f"{path}/_SUCCESS") else None

    def prepare(self, strategy: str, basenames: DataFrame, models: DataFrame, patterns: DataFrame, known_dirs: DataFrame, tier: str = "default", start: str = C.FIRST_DAY, end: str | None = None, cap: int | None = None, ranges: int | None = None) -> Candidates:
        """The sweep's candidates; those that it was prepared with, if it was. Without an end, today is frozen as the end."""
        if self._settings() is None:
            end = end or sinks.run_id()[:10]
            for name, column in SIDES.items():
                {"basenames": basenames, "models": models, "patterns": patterns, "known_dirs": known_dirs}[name].select(column).write.mode("overwrite").parquet(f"{self.folder}/{name}")
            size = self._plan({"strategy": strategy, "tier": tier, "start": start, "end": end}).size
            size = size if cap is None else min(size, cap)
            n = ranges or -(-size // RANGE) or 1
            step = -(-size // n) or 1
            cuts = self.spark.range(0, size, step, numPartitions=max(1, -(-size // step)))
            cuts.select(F.col("id").alias("lo"), F.least(F.col("id") + step, F.lit(size)).alias("hi")).write.mode("overwrite").parquet(f"{self.folder}/ranges")
            settings = {"strategy": strategy, "tier": tier, "start": start, "end": end, "size": size, "run_dir": f"{self.data_dir}/scrapes/{sinks.run_id()}"}
            self.spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/settings")
        return self._plan(self._settings())

    def _plan(self, settings: dict) -> Candidates:
        sides = [self.spark.read.schema(f"{c} string").parquet(f"{self.folder}/{n}") for n, c in SIDES.items()]
        return plan_candidates(self.spark, settings["strategy"], *sides, settings["tier"], settings["start"], settings["end"])

    def _kept(self, name: str, batch: int, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}/batch={batch}"
        if not sinks.exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def run(self, plan: Candidates) -> dict:
        """Asks for all ranges that have no answers yet. candidates_checked, hits_dates, hits_models, errors, run_dir."""
        settings = self._settings()

        def sweep(ranges: DataFrame, batch: int) -> None:
            made = None
            for r in ranges.collect():  # one row for each file of a batch
                made = plan.slice(r["lo"], r["hi"]) if made is None else made.unionByName(plan.slice(r["lo"], r["hi"]))
            if made is None:
                return
            asked = self._kept("asked", batch, lambda: made.select("strategy", canonical(F.col("url")).alias("url")))
            requests = asked.select(at_origin(F.col("url")).alias("request_url")).distinct()
            answers = self._kept("answers", batch, lambda: self.ask(requests).select("request_url", F.col("status").cast("int").alias("status")))
            there = answers.where("status = 200").select(F.col("request_url").alias("there")).distinct()
            hits = self._kept("hits", batch, lambda: asked.join(there, at_origin(F.col("url")) == F.col("there"), "left_semi"))
            errors = sinks.append_hits(hits, settings["run_dir"], batch)
            if errors:
                raise OSError(f"{errors} files of hits of batch {batch} could not be written")

        source = self.spark.readStream.schema("lo bigint, hi bigint").option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/ranges")
        query = source.writeStream.foreachBatch(sweep).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        hits = self.hits()
        errors = sinks.join_hits(self.spark, hits, settings["run_dir"])
        n = {r["strategy"]: r["count"] for r in hits.groupBy("strategy").count().collect()}
        return {"candidates_checked": settings["size"], "hits_dates": n.get("dates", 0), "hits_models": n.get("models", 0), "errors": errors, "run_dir": settings["run_dir"]}

    def hits(self) -> DataFrame:
        """strategy and url of all hits so far, also while the sweep runs."""
        if not sinks.exists(self.spark, f"{self.folder}/hits"):
            return self.spark.createDataFrame([], "strategy string, url string")
        return self.spark.read.schema("strategy string, url string").parquet(f"{self.folder}/hits").select("strategy", "url")
