"""The corpus of scraped lists, kept up to date by what changed: new, overwritten and deleted files.

A manifest tells which files are in (path, size, time). For each file its distinct URLs are kept, in the table of the version
that read it. A URL is in the corpus while some file holds it, which is counted: a version adds one for each new pair of file
and URL and takes one off for each that is gone. A version is there when its manifest is; one that broke is made again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.urls import canonical
from linkloom.plans import sinks
from linkloom.sources.readers import lines_of_files

LISTED = "path string, size bigint, modified timestamp"
MANIFEST = "path string, size bigint, modified timestamp, since int"
#: Versions after which counts are summed up anew.
COMPACT = 32


@dataclass
class Corpus:
    """folder: of the lists. state: of the manifest and counts, in the shared file system."""

    spark: SparkSession
    folder: str
    state: str

    def version(self) -> int:
        """The last one that is whole; 0: none."""
        n = 0
        while sinks.exists(self.spark, f"{self.state}/manifest/{n + 1}/_SUCCESS"):
            n += 1
        return n

    def _table(self, name: str, version: int, ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl).parquet(f"{self.state}/{name}/{version}")

    def manifest(self, version: int) -> DataFrame:
        return self._table("manifest", version, MANIFEST) if version else self.spark.createDataFrame([], MANIFEST)

    def listed(self) -> DataFrame:
        """The files as they are: no content is read."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(self.folder)
        return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    def update(self) -> dict[str, int]:
        """Takes in what changed. files_read, files_gone (overwritten ones are both), version."""
        old, key = self.version(), ["path", "size", "modified"]
        new = old + 1
        # listed once, before any file is read: one that changes later differs from its entry, and is read again by the next update
        self.listed().write.mode("overwrite").parquet(f"{self.state}/listed/{new}")
        before, now = self.manifest(old), self._table("listed", new, LISTED)
        stay = before.join(now, key, "left_semi")
        read = [r[0] for r in now.join(before, key, "left_anti").select("path").collect()]  # names of files, as any scan of them needs
        gone = before.join(now, key, "left_anti").select("path", "since").collect()
        if not read and not gone:
            return {"files_read": 0, "files_gone": 0, "version": old}
        if read:
            lines = lines_of_files(self.spark, [re.sub(r"([\\*?\[\]{}])", r"\\\1", path) for path in read])  # names, not patterns
            # paths of files that are read come percent-encoded, unlike those that are listed
            path = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
            held = lines.select(path.alias("path"), canonical(F.col("value")).alias("url")).where("url <> ''").distinct()
        else:
            held = self.spark.createDataFrame([], "path string, url string")
        held.write.mode("overwrite").parquet(f"{self.state}/held/{new}")
        change = self._table("held", new, "path string, url string").select("url", F.lit(1).alias("n"))
        for since in sorted({r["since"] for r in gone}):
            paths = [r["path"] for r in gone if r["since"] == since]
            lost = self._table("held", since, "path string, url string").join(F.broadcast(self.spark.createDataFrame([(p,) for p in paths], "path string")), "path")
            change = change.unionByName(lost.select("url", F.lit(-1).alias("n")))
        if new % COMPACT == 0:
            change = change.unionByName(self._counts(old))
        summed = change.groupBy("url").agg(F.sum("n").cast("int").alias("n")).where("n <> 0")
        summed.write.mode("overwrite").parquet(f"{self.state}/counts/{new}")
        since = now.join(stay.select("path", "since"), "path", "left").withColumn("since", F.coalesce("since", F.lit(new)))
        since.select("path", "size", "modified", "since").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/manifest/{new}")
        return {"files_read": len(read), "files_gone": len(gone), "version": new}

    def _counts(self, version: int) -> DataFrame:
        whole = version - version % COMPACT  # that one holds all before it
        paths = [f"{self.state}/counts/{v}" for v in range(max(1, whole), version + 1)]
        return self.spark.read.schema("url string, n int").parquet(*paths) if paths else self.spark.createDataFrame([], "url string, n int")

    def urls(self) -> DataFrame:
        """All canonical URLs of the files that the last version knows, each once."""
        return self._counts(self.version()).groupBy("url").agg(F.sum("n").alias("n")).where("n > 0").select("url")
