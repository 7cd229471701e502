"""Candidate generators: lazy cross products with small literal sides, and the same candidates by ordinal, where a cap, a shard
or a sweep that is taken up again asks for a range of them. No product is materialised."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import constants as C
from linkloom.functions.urls import insert_variant
from linkloom.operators.extract import product_tree
from linkloom.operators.ordinals import Side, Space, listed, ranked


def literals(spark: SparkSession, name: str, values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def date_paths(spark: SparkSession, start: str = C.FIRST_DAY, end: str | None = None, bare: bool = True) -> DataFrame:
    """day, form (0: under the upload root, 1: bare), date_path; no rows if start is after end."""
    last = F.to_date(F.lit(end)) if end else F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))
    days = spark.range(1).select(F.to_date(F.lit(start)).alias("s"), last.alias("e")).where("s <= e").select(F.explode(F.sequence("s", "e")).alias("day"))
    tail = F.date_format("day", "/yyyy/yyyyMM/yyyyMMdd/")
    forms = F.array(F.concat(F.lit(C.DATE_ROOT.rstrip("/")), tail), tail) if bare else F.array(F.concat(F.lit(C.DATE_ROOT.rstrip("/")), tail))
    return days.select("day", F.posexplode(forms).alias("form", "date_path"))


def date_candidates(basenames: DataFrame, paths: DataFrame) -> DataFrame:
    """basenames: basename; paths: date_path. Each name, and its re-uploaded variants, on each path."""
    names = basenames.select(F.col("basename"), F.explode(F.array(F.lit(""), *map(F.lit, C.REUPLOADS))).alias("v"))
    names = names.select(F.when(F.col("v") == "", F.col("basename")).otherwise(insert_variant(F.col("basename"), F.col("v"))).alias("name"))
    return names.crossJoin(paths.select("date_path")).select(F.concat(F.lit(f"https://{C.ARCHIVE_HOST}"), "date_path", "name").alias("url"))


def model_candidates(models: DataFrame, patterns: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """models: model; patterns: pattern. Each model in each pattern with each suffix, in the flat folder or on each path."""
    names = models.select("model").crossJoin(patterns.select("pattern")).withColumn("ext", F.explode(F.array(*map(F.lit, C.CANDIDATE_EXTENSIONS))))
    names = names.select(F.concat(F.replace("pattern", F.lit("{model}"), F.col("model")), F.lit("."), F.col("ext")).alias("name"))
    if paths is None:
        return names.select(F.concat(F.lit(f"https://{C.ARCHIVE_HOST}{C.FLAT_ROOT}"), "name").alias("url"))
    return names.crossJoin(paths.select("date_path")).select(F.concat(F.lit(f"https://{C.ARCHIVE_HOST}"), "date_path", "name").alias("url"))


def known_date_dirs(lines: DataFrame) -> DataFrame:
    """lines: value. Distinct date folders, all under the upload root."""
    path = F.regexp_extract("value", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    segment = F.regexp_extract(path, C.DATE_SEGMENT, 1)
    return lines.select(segment.alias("s")).where("s <> ''").distinct().select(F.concat(F.lit(C.DATE_ROOT), "s").alias("date_path"))


def day_sides(start: str, end: str | None, bare: bool = True) -> tuple[Side, Side]:
    """Days from start to end (none: today), and what comes before a day in a path; both by rule."""
    last = date.fromisoformat(end) if end else datetime.now(UTC).date()
    roots = (C.DATE_ROOT.rstrip("/"), "") if bare else (C.DATE_ROOT.rstrip("/"),)
    folder = lambda digit: F.date_format(F.date_add(F.lit(start).cast("date"), digit.cast("int")), "/yyyy/yyyyMM/yyyyMMdd/")
    return Side("day", max(0, (last - date.fromisoformat(start)).days + 1), folder), listed("root", roots)


@dataclass(frozen=True)
class Candidates:
    """The candidates of a strategy and tier by ordinal: dates first, then models, never crossed with one another."""

    parts: tuple[tuple[str, Space], ...]

    @property
    def size(self) -> int:
        return sum(space.size for _, space in self.parts)

    def counts(self, cap: int | None = None) -> dict[str, int]:
        """How many there are by strategy, of the first cap of all."""
        out, left = {"dates": 0, "models": 0}, self.size if cap is None else cap
        for name, space in self.parts:
            out[name] = min(space.size, left)
            left -= out[name]
        return out

    def slice(self, lo: int = 0, hi: int | None = None) -> DataFrame:
        """strategy, ordinal and url of those numbered lo to hi - 1, in no order."""
        made, start, hi = [], 0, self.size if hi is None else hi
        for name, space in self.parts:
            rows = space.rows(max(0, lo - start), max(0, hi - start))
            url = F.concat(F.lit(f"https://{C.ARCHIVE_HOST}"), *_URL[name](space))
            made.append(rows.select(F.lit(name).alias("strategy"), (F.col("ordinal") + start).alias("ordinal"), url.alias("url")))
            start += space.size
        return reduce(DataFrame.unionByName, made)


def _folder(space: Space) -> list[Column]:
    return [F.col(s.name) for s in reversed(space.sides) if s.name == "root"] + [F.col(s.name) for s in space.sides if s.name in ("day", "date_path")]


#: What a candidate's URL is made of, after the host.
_URL: dict[str, Callable[[Space], list[Column]]] = {
    "dates": lambda space: [*_folder(space), F.when(F.col("variant") == "", F.col("basename")).otherwise(insert_variant(F.col("basename"), F.col("variant")))],
    "models": lambda space: [*_folder(space), F.replace("pattern", F.lit("{model}"), F.col("model")), F.lit("."), F.col("ext")],
}


def plan_candidates(spark: SparkSession, strategy: str, basenames: DataFrame, models: DataFrame, patterns: DataFrame, known_dirs: DataFrame, tier: str = "default", start: str = C.FIRST_DAY, end: str | None = None) -> Candidates:
    """Orders: day, form, name, variant; model, pattern, suffix, path. Names, models, patterns and known folders are distinct and
    go by their bytes.

    Tier exhaustive puts models on every day's paths, thorough on known folders (or the flat folder if there are none).
    """
    if strategy not in ("dates", "models", "all"):
        raise ValueError(f"no such strategy: {strategy}")
    parts, days = [], day_sides(start, end)
    if strategy != "models":
        parts.append(("dates", Space(spark, (*days, ranked(basenames, "basename"), listed("variant", ("", *C.REUPLOADS))))))
    if strategy != "dates":
        known = ranked(known_dirs, "date_path") if tier == "thorough" else None
        paths = days if tier == "exhaustive" else (known,) if known is not None and known.size else (listed("date_path", (C.FLAT_ROOT,)),)
        parts.append(("models", Space(spark, (ranked(models, "model"), ranked(patterns, "pattern"), listed("ext", C.CANDIDATE_EXTENSIONS), *paths))))
    return Candidates(tuple(parts))


def candidates(spark: SparkSession, strategy: str, basenames: DataFrame, models: DataFrame, patterns: DataFrame, known_dirs: DataFrame, tier: str = "default", start: str = C.FIRST_DAY, end: str | None = None, cap: int | None = None) -> DataFrame:
    """strategy, url: all of plan_candidates(), or the first cap of them in its order."""
    return plan_candidates(spark, strategy, basenames, models, patterns, known_dirs, tier, start, end).slice(0, cap).drop("ordinal")


def candidate_counts(spark: SparkSession, strategy: str, basenames: DataFrame, models: DataFrame, patterns: DataFrame, known_dirs: DataFrame, tier: str = "default", start: str = C.FIRST_DAY, end: str | None = None, cap: int | None = None) -> dict[str, int]:
    """How many candidates() there are by strategy, from the sizes of the sides."""
    return plan_candidates(spark, strategy, basenames, models, patterns, known_dirs, tier, start, end).counts(cap)


def region_codes(spark: SparkSession) -> DataFrame:
    """aa to zz."""
    letter = spark.range(26).select(F.chr(F.col("id") + 97).alias("c"))
    return letter.crossJoin(letter.withColumnRenamed("c", "d")).select(F.concat("c", "d").alias("region"))


def live_regions(codes: DataFrame, responses: DataFrame) -> DataFrame:
    """Codes whose page is there and holds a product tree; a page alone is no proof."""
    good = responses.where((F.col("status") == 200) & product_tree(F.col("body")).isNotNull()).select("region")
    return codes.join(good, "region", "left_semi")


def all_regions(spark: SparkSession, live: DataFrame, picked: DataFrame) -> DataFrame:
    return literals(spark, "region", C.REGIONS).union(live.select("region")).union(picked.select("region")).distinct()


def requests(spark: SparkSession, **sides) -> DataFrame:
    """The cross product of literal lists or frames of one column, for example prefixes by indices."""
    frames = [v if isinstance(v, DataFrame) else literals(spark, k, v) for k, v in sides.items()]
    return reduce(DataFrame.crossJoin, frames)


def crawl_pages(queries: DataFrame) -> DataFrame:
    """queries: pages and others. One row for each page from 0."""
    return queries.where("pages > 0").withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages").cast("int") - 1)))
