"""Completion of what is typed, by kind of argument, through an index of short substrings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: values of a completion at most.
MOST = 100
#: Characters of the longest substrings in the index; shorter ones are in it, too.
GRAM = 3


def _cuts(low: Column, n: int) -> Column:
    # the upper bound of a sequence must not fall below its lower one
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1)))
    return F.when(F.length(low) >= n, F.transform(starts, lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _grams(low: Column) -> Column:
    """Distinct substrings of up to ``GRAM`` characters."""
    return F.array_distinct(reduce(F.concat, [_cuts(low, n) for n in range(1, GRAM + 1)]))


@dataclass(frozen=True)
class CompletionIndex:
    """``grams(kind, gram, value)``, sorted by kind and gram where saved, and ``values(kind, value)``."""

    grams: DataFrame
    values: DataFrame

    def save(self, path: str) -> None:
        self.grams.repartitionByRange("kind", "gram").sortWithinPartitions("kind", "gram").write.mode("overwrite").parquet(f"{path}/grams")
        self.values.repartitionByRange("kind", "value").sortWithinPartitions("kind", "value").write.mode("overwrite").parquet(f"{path}/values")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CompletionIndex:
        return cls(spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/values"))


def index(candidates: DataFrame, kind: str = "kind", value: str = "value") -> CompletionIndex:
    """The index of distinct values of each kind; null and blank values complete nothing."""
    values = candidates.select(F.col(kind).alias("kind"), F.col(value).alias("value")).where(F.length(F.trim("value")) > 0).distinct()
    return CompletionIndex(values.select("kind", F.explode(_grams(F.lower("value"))).alias("gram"), "value"), values)


def complete(found: CompletionIndex, kind: str, typed: str, most: int = MOST) -> DataFrame:
    """(value, total, has_more): values of a kind that hold what was typed, those that hold it earliest first, then the shorter, then in order.

    Only values that have all of its substrings are looked at; ``total`` counts
    all that hold it. Case and white space around it don't matter; nothing typed
    gives the first values in order. An unknown kind has none.
    """
    needle = typed.strip().lower()
    if needle:
        asked = sorted({needle[i : i + GRAM] for i in range(max(1, len(needle) - GRAM + 1))})
        rows = found.grams.where((F.col("kind") == kind) & F.col("gram").isin(asked)).groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") == len(asked))
        rows = rows.select("value", F.instr(F.lower("value"), needle).alias("at")).where("at > 0")
    else:
        rows = found.values.where(F.col("kind") == kind).select("value", F.lit(1).alias("at"))
    order = ["at", F.length("value") if needle else F.lit(1), "value"]
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(total)).orderBy(*order).select("value", "total", (F.col("total") > most).alias("has_more"))


def resource_candidates(packets: DataFrame) -> DataFrame:
    """(kind, value) of what a packet's resources can be asked for: its id, for a screenshot only where it has one."""
    kinds = F.array(*[F.lit(k) for k in ("packet", "content", "normalized")])
    if "screenshot" in packets.columns:
        kinds = F.concat(kinds, F.when(F.col("screenshot").isNotNull(), F.array(F.lit("screenshot"))).otherwise(F.array().cast("array<string>")))
    return packets.select(F.explode(kinds).alias("kind"), F.col("source_id").alias("value"))
