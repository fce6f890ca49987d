"""Chains of redirects, followed over a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: redirects that are followed at most.
MOST = 5


def follow(urls: DataFrame, redirects: DataFrame, most: int = MOST, url: str = "url", src: str = "src", dst: str = "dst") -> DataFrame:
    """Each distinct ``url`` with ``final_url``, ``hops`` and ``verdict``.

    ``redirects`` has a row for each ``src`` that redirects to ``dst``; of several
    the smallest counts, a null ``dst`` is a redirect without a location. The
    verdict is ``OK``, ``INVALID_REDIRECT``, ``REDIRECT_LOOP`` (a URL comes twice) or
    ``TOO_MANY_REDIRECTS``, and ``final_url`` is null unless it is ``OK``. A null
    URL is left out.

    One join a hop, ``most`` + 1 in all, each with the same table: a recursive
    query would do, but Spark ends those beyond a number of rows. A URL that
    ended stays in place; its last URL has no redirect, so it matches nothing.
    """
    to = redirects.where(F.col(src).isNotNull()).groupBy(F.col(src).alias("_src")).agg(F.min(dst).alias("_dst"))
    rows = urls.where(F.col(url).isNotNull()).select(F.col(url).alias("_url")).distinct()
    rows = rows.select("_url", F.array("_url").alias("_path"), F.col("_url").alias("_at"), F.lit(None).cast("string").alias("_verdict"))
    for hop in range(most + 1):
        rows = rows.join(to, F.col("_at") == F.col("_src"), "left")
        moved = F.col("_verdict").isNull() & F.col("_src").isNotNull() & F.col("_dst").isNotNull()
        beyond = F.lit("TOO_MANY_REDIRECTS") if hop == most else F.when(F.array_contains("_path", F.col("_dst")), "REDIRECT_LOOP")
        verdict = F.when(F.col("_verdict").isNotNull(), F.col("_verdict")).when(F.col("_src").isNull(), "OK").when(F.col("_dst").isNull(), "INVALID_REDIRECT").otherwise(beyond)
        rows = rows.select(
            "_url", F.when(moved, F.concat("_path", F.array("_dst"))).otherwise(F.col("_path")).alias("_path"),
            F.when(moved, F.col("_dst")).otherwise(F.col("_at")).alias("_at"), verdict.alias("_verdict"),
        )
    return rows.select(F.col("_url").alias(url), F.when(F.col("_verdict") == "OK", F.col("_at")).alias("final_url"), (F.size("_path") - 1).alias("hops"), F.col("_verdict").alias("verdict"))
