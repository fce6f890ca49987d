"""Running results over time for keys of any size, in two levels.

Rows are cut by key and by stretches of time. A stretch is summed up in one row;
what carries over runs over those rows, and within a stretch over its own. So a
key that has a third of all rows meets nowhere as a whole. Times are whole
numbers (microseconds), and rows of equal time are taken in order of ``ties``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of a second.
SECOND = 1_000_000


def micros(at: str | Column) -> Column:
    """A timestamp as microseconds."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def stretch(at: str, width: int) -> Column:
    """The number of the stretch of time that ``at`` falls into."""
    return F.floor(F.col(at) / F.lit(width)).cast("long")


def with_segment(rows: DataFrame, key: str, at: str, until: str, width: int) -> DataFrame:
    """``rows`` with ``segment``: rows of a key whose spans ``at``..``until`` don't reach each other may differ in it.

    What a row does lasts until ``until`` at most, so every segment begins with
    nothing left of what was before, and segments can be worked on apart. Only
    stretches are compared, so gaps shorter than one may be missed; that costs
    parallelism, not results.
    """
    rows = rows.withColumn("_s", stretch(at, width))
    per = rows.groupBy(key, "_s").agg(F.min(at).alias("_lo"), F.max(F.greatest(at, until)).alias("_hi"))
    order = Window.partitionBy(key).orderBy("_s")
    reached = F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("_new", F.when(reached.isNull() | (F.col("_lo") > reached), F.col("_s")))
    segment = F.last("_new", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(per.select(key, "_s", segment.alias("segment")), [key, "_s"]).drop("_s")


def after_delays(rows: DataFrame, key: str, at: str, delay: str, ties: tuple[str, ...] = (), width: int = 3600 * SECOND) -> DataFrame:
    """``rows`` with ``start``: start_i = max(at_i, start_(i-1) + delay_i), a key's first at its own time.

    In sums and maxima: with D_i the sum of delays up to i, start_i = D_i +
    max over j <= i of (at_j - D_j). Both parts run over stretches first.
    """
    rows = rows.withColumn("_s", stretch(at, width))
    inside = Window.partitionBy(key, "_s").orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_d", F.sum(delay).over(inside)).withColumn("_v", F.col(at) - F.col("_d"))
    rows = rows.withColumn("_m", F.max("_v").over(inside))
    per = rows.groupBy(key, "_s").agg(F.sum(delay).alias("_sum"), F.max("_v").alias("_top"))
    earlier = Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    per = per.withColumn("_best", F.max(F.col("_top") - F.col("_before")).over(earlier)).drop("_sum", "_top")
    rows = rows.join(per, [key, "_s"])
    start = F.col("_before") + F.col("_d") + F.greatest(F.col("_m") - F.col("_before"), F.col("_best"))
    return rows.withColumn("start", start).drop("_s", "_d", "_v", "_m", "_before", "_best")


def latest_before(rows: DataFrame, key: str, at: str, value: str | Column, name: str, ties: tuple[str, ...] = (), width: int = 3600 * SECOND) -> DataFrame:
    """``rows`` with ``name``: the last ``value`` that is not null among the key's rows up to each."""
    rows = rows.withColumn("_s", stretch(at, width)).withColumn("_x", F.col(value) if isinstance(value, str) else value)
    upto = Window.unboundedPreceding, Window.currentRow
    inside = Window.partitionBy(key, "_s").orderBy(at, *ties)
    rows = rows.withColumn("_here", F.last("_x", ignorenulls=True).over(inside.rowsBetween(*upto)))
    order = F.struct(at, *ties)
    per = rows.groupBy(key, "_s").agg(F.max_by("_x", F.when(F.col("_x").isNotNull(), order)).alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(key, "_s", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    rows = rows.join(per, [key, "_s"])
    return rows.withColumn(name, F.coalesce("_here", "_carried")).drop("_s", "_x", "_here", "_carried")


def trailing(rows: DataFrame, key: str, at: str, width: int, name: str) -> DataFrame:
    """``rows`` with ``name``: how many rows of the key lie within ``width`` up to each, both ends included.

    A row counts for its own stretch of that width and for the next one, so a
    window never needs a third.
    """
    both = rows.withColumn("_s", F.explode(F.array(stretch(at, width), stretch(at, width) + 1)))
    window = Window.partitionBy(key, "_s").orderBy(at).rangeBetween(-width, 0)
    return both.withColumn(name, F.count("*").over(window)).where(F.col("_s") == stretch(at, width)).drop("_s")
