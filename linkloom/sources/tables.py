"""Responses and discoveries as tables that lookups meet without moving them: bucketed and sorted by the URL that is looked up.

A lookup shuffles what is looked up, into as many partitions as the table has buckets; the table itself is read bucket by
bucket, however often it is asked. The bound of a bucket's size is what the number of buckets is chosen by.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.urls import canonical
from linkloom.operators.verify import asked_key, latest


@dataclass(frozen=True)
class BucketedTable:
    """name in the session's catalog, path in the shared file system, key column and number of buckets."""

    spark: SparkSession
    name: str
    path: str
    key: str
    buckets: int

    def write(self, rows: DataFrame) -> BucketedTable:
        """Replaces the table. Rows come to their bucket's task first, so each bucket is one sorted file."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        ready = rows.repartition(self.buckets, self.key)
        ready.write.bucketBy(self.buckets, self.key).sortBy(self.key).mode("overwrite").option("path", self.path).saveAsTable(self.name)
        return self

    def attach(self, columns: str) -> BucketedTable:
        """Of a table that another session wrote: its columns as DDL."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forgets the name; files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def response_table(responses: DataFrame, name: str, path: str, buckets: int) -> BucketedTable:
    """The latest response of each address, by the canonical URL that it stands for."""
    keyed = latest(responses.withColumn("request_url", asked_key(F.col("request_url"))))
    return BucketedTable(responses.sparkSession, name, path, "request_url", buckets).write(keyed)


def discovery_table(urls: DataFrame, name: str, path: str, buckets: int) -> BucketedTable:
    """urls: url. Each canonical URL once."""
    once = urls.select(canonical(F.col("url")).alias("url")).where("url <> ''").distinct()
    return BucketedTable(urls.sparkSession, name, path, "url", buckets).write(once)


def existing_in(candidates: DataFrame, table: BucketedTable) -> DataFrame:
    """candidates: url and others. Those whose latest response is 200."""
    there = table.read().where("status = 200").select(F.col(table.key).alias("_there"))
    return _by_key(candidates).join(there, F.col("_key") == F.col("_there"), "left_semi").drop("_key")


def unseen_in(urls: DataFrame, table: BucketedTable) -> DataFrame:
    """urls: url and others. Those that are not in the table."""
    known = table.read().select(F.col(table.key).alias("_known"))
    return _by_key(urls).join(known, F.col("_key") == F.col("_known"), "left_anti").drop("_key")


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_key", canonical(F.col("url")))
