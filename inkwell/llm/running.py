"""Running sums over a group of any size, without bringing the group together.

A group's rows are ordered by a key whose hexadecimal digits are spread evenly.
Its first digits cut the group into buckets: sums of buckets run over a small
table, sums of rows run within a bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket of the largest possible group holds, about.
BUCKET_ROWS = 2000


def spread_key(seed: str, *columns: Column) -> Column:
    """An even, repeatable order: MD5 of the seed and the columns, in hexadecimal."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def with_running(rows: DataFrame, group: list[str], key: str, order: list[str], sums: dict[str, str], per_group: DataFrame | None = None) -> DataFrame:
    """``rows`` with, for each ``new: column`` of ``sums``, the sum of the rows before it in its group.

    ``group`` columns must not be null. Rows that tie in ``key`` and ``order``
    are taken in any order, so they should be equal. ``per_group`` columns (one
    row a group) are attached on the way, at the level of buckets. Rows are
    dealt by group and bucket, however they were dealt before.
    """
    n = rows.count()
    digits = max(1, min(8, math.ceil(math.log(max(n, 1) / BUCKET_ROWS, 16)))) if n > BUCKET_ROWS else 1
    # dealt anew: rows that a join dealt by group alone would keep a hot group in one task
    rows = rows.withColumn("_bucket", F.substring(key, 1, digits)).repartition(*group, "_bucket")
    buckets = rows.groupBy(*group, "_bucket").agg(*[F.sum(c).alias(f"_in_{new}") for new, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumns({f"_up_{new}": F.coalesce(F.sum(f"_in_{new}").over(before), F.lit(0)) for new in sums})
    if per_group is not None:
        buckets = buckets.join(per_group, group)
    inside = Window.partitionBy(*group, "_bucket").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({new: F.coalesce(F.sum(c).over(inside), F.lit(0)) for new, c in sums.items()})
    rows = rows.join(buckets, [*group, "_bucket"])
    rows = rows.withColumns({new: F.col(new) + F.col(f"_up_{new}") for new in sums})
    return rows.drop("_bucket", *[f"_in_{new}" for new in sums], *[f"_up_{new}" for new in sums])
