"""Files to rows."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.generate import known_date_dirs
from linkloom.operators.verify import canonical_set
from linkloom.functions.tokens import known_basenames
from linkloom.sources.arrays import array_elements


def _there(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


@dataclass(frozen=True)
class DataPaths:
    """Where inputs are; a file is sought in each root in turn: below the working folder, then beside the package."""

    roots: tuple[str, ...] = ("data", f"file://{PurePosixPath(__file__).parents[2] / 'data'}")

    def candidates(self, name: str) -> list[str]:
        return [str(PurePosixPath(r) / name) if "://" not in r else f"{r.rstrip('/')}/{name}" for r in self.roots]

    def resolve(self, spark: SparkSession, name: str) -> str | None:
        return next((p for p in self.candidates(name) if _there(spark, p)), None)

    def given_or(self, spark: SparkSession, given: str | None, name: str) -> str | None:
        """The given path, if it is there; else the file of the same name in the roots, or, if none is given, the named one."""
        if given is None:
            return self.resolve(spark, name)
        return given if _there(spark, given) else self.resolve(spark, given.rstrip("/").rsplit("/", 1)[-1]) or given


def scrape_lines(spark: SparkSession, folder: str) -> DataFrame:
    """value, file, run_id, source of each line of all *.txt below the folder; unreadable files are skipped. Files of the parts of
    a sweep (name.000012.txt) are of one source."""
    return lines_of_files(spark, folder, recursiveFileLookup=True, pathGlobFilter="*.txt")


def lines_of_files(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """As scrape_lines(), of given files."""
    raw = spark.read.options(ignoreCorruptFiles=True, ignoreMissingFiles=True, **options).text(paths)
    file = F.col("_metadata.file_path")
    parts = F.split(file, "/")
    rows = raw.select(F.explode(F.split(F.make_valid_utf8("value"), r"[\x0b\x0c\x1c-\x1e\x85  ]")).alias("value"), file.alias("file"), parts.alias("p"))
    return rows.select("value", "file", F.element_at("p", -2).alias("run_id"), F.regexp_replace(F.element_at("p", -1), r"(\.\d{6})?\.txt$", "").alias("source"))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All canonical URLs of the folder, each once."""
    return canonical_set(scrape_lines(spark, folder))


def firmware_listing(spark: SparkSession, path: str) -> DataFrame:
    """key, size, modified of the objects in a JSON array; entries whose key is no string are left out. An array is cut into
    chunks that all tasks read, at any size, as is a listing of one object to a line (*.jsonl, *.ndjson)."""
    if path.endswith((".jsonl", ".ndjson")):
        return _keyed(spark.read.text(path).where(F.ltrim("value").startswith("{")).select(F.try_parse_json("value").alias("v")))
    return _keyed(array_elements(spark, path).select(F.try_parse_json("element").alias("v")))


def _keyed(parsed: DataFrame) -> DataFrame:
    rows = parsed.where("schema_of_variant(variant_get(v, '$.key', 'variant')) = 'STRING'")
    return rows.selectExpr("variant_get(v, '$.key', 'string') AS key", "coalesce(try_variant_get(v, '$.size', 'bigint'), 0) AS size", "try_variant_get(v, '$.modified', 'string') AS modified")


def known_corpus(spark: SparkSession, path: str | None) -> tuple[DataFrame, DataFrame]:
    """Distinct basenames and known date folders of a list of URLs; both empty if there is no such file."""
    if path is None:
        return spark.createDataFrame([], "basename string"), spark.createDataFrame([], "date_path string")
    lines = spark.read.text(path)
    plain = lines.select(F.regexp_replace("value", r"[?#].*$", "").alias("value"))
    return known_basenames(plain).where("basename <> ''").distinct(), known_date_dirs(lines)
