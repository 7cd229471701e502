"""Products of several sides by ordinal: the n-th row is decoded from n alone, so any range of rows can be made by itself.

An ordinal is a number of mixed radix, with a digit for each side, the outermost first. Sides of a rule (days, forms,
suffixes) give a digit's value by an expression; sides of data are numbered once, in a table, and looked up by number. A
cap is a range from 0, a shard any other; there is nothing to sort, to limit or to enumerate beforehand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.session import stored

#: A side of up to this many values is broadcast; a larger one stays where it is, and each of its rows makes its own ordinals.
BROADCAST_VALUES = 500_000


@dataclass(frozen=True)
class Side:
    """name and size; and the value of a digit, or a table of rank and value."""

    name: str
    size: int
    value: Callable[[Column], Column] | None = None
    table: DataFrame | None = None


def listed(name: str, values) -> Side:
    """A side of few literal values."""
    each = F.array(*map(F.lit, values))
    return Side(name, len(values), lambda digit: F.get(each, digit))


def ranked(frame: DataFrame, name: str) -> Side:
    """The distinct non-null values of the column, numbered from 0 in the order of their bytes.

    Sorting is by ranges, and ranks follow from how many values the ranges before hold: one row for each range is all that
    the driver gets, and the count of the values is theirs."""
    spark = frame.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = frame.select(F.col(name).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    number = F.monotonically_increasing_id()
    local = stored(values.repartitionByRange(n, "value").sortWithinPartitions("value").select("value", F.shiftright(number, 33).cast("int").alias("part"), number.bitwiseAND((1 << 33) - 1).alias("nth")), name)
    sizes = {r["part"]: r["n"] for r in local.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    offsets = spark.createDataFrame(starts, "part int, start bigint")
    return Side(name, before, table=local.join(F.broadcast(offsets), "part").select((F.col("start") + F.col("nth")).alias("rank"), "value"))


@dataclass(frozen=True)
class Space:
    spark: SparkSession
    sides: tuple[Side, ...]
    broadcast_values: int = BROADCAST_VALUES

    @property
    def size(self) -> int:
        return prod(s.size for s in self.sides)

    def _weight(self, side: Side) -> int:
        return prod(s.size for s in self.sides[self.sides.index(side) + 1 :])

    def _digit(self, side: Side) -> Column:
        return F.expr(f"CAST(ordinal DIV {self._weight(side)} % {side.size} AS BIGINT)")

    def _of_rows(self, side: Side, lo: int, hi: int) -> DataFrame:
        """The ordinals from lo to hi - 1 in which each value of the side occurs: for each turn of the sides outside it, a run of
        those inside it."""
        w, turn = self._weight(side), self._weight(side) * side.size
        first, last = F.expr(f"{lo} DIV {turn}"), F.expr(f"{hi - 1} DIV {turn}")
        rows = side.table.select("rank", F.col("value").alias(side.name), F.explode(F.sequence(first, last)).alias("outer"))
        start = F.col("outer") * turn + F.col("rank") * w
        rows = rows.select(side.name, F.greatest(start, F.lit(lo)).alias("a"), F.least(start + w, F.lit(hi)).alias("b")).where("a < b")
        return rows.select(side.name, F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("ordinal"))

    def rows(self, lo: int = 0, hi: int | None = None) -> DataFrame:
        """ordinal and a column for each side, for ordinals from lo to hi - 1, in no order."""
        hi = self.size if hi is None else min(hi, self.size)
        tables = [s for s in self.sides if s.table is not None]
        large = max((s for s in tables if s.size > self.broadcast_values), key=lambda s: s.size, default=None)
        if lo >= hi:
            out = self.spark.range(0).withColumnRenamed("id", "ordinal")
        elif large is None:
            out = self.spark.range(lo, hi).withColumnRenamed("id", "ordinal")
        else:
            out = self._of_rows(large, lo, hi)
        for s in self.sides:
            if s.value is not None:
                out = out.withColumn(s.name, s.value(self._digit(s)))
            elif s.name not in out.columns:
                near = s.table.select(F.col("rank").alias(f"_{s.name}"), F.col("value").alias(s.name))
                near = near if s.size > self.broadcast_values else F.broadcast(near)
                out = out.join(near, self._digit(s) == F.col(f"_{s.name}")).drop(f"_{s.name}")
        return out
