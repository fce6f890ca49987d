"""Connected components by alternating large-star and small-star joins.

The links stay distributed: no link, label or component reaches the driver,
which sees one count a round. Both steps take a minimum a node with a
map-side combine and a join that adaptive execution may split, so a node with
a great many links is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """Columns ``node``, ``root`` for every node of ``links(a, b)`` that is not its root.

    The root is the smallest node reachable. Loops and repeated links do no
    harm; links with a null end are left out; no links give no rows.
    """
    star = cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _stars(star):
        both = _ways(star)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every node now links to a smaller one only: u > v
        large = cut(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return star.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _ways(star: DataFrame) -> DataFrame:
    """Each link both ways; ``up`` marks the given one."""
    ways = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v"), F.lit(up).alias("up")) for a, b, up in (("u", "v", 1), ("v", "u", 0))])
    return star.select(F.inline(ways))


def _stars(star: DataFrame) -> bool:
    """Whether every node has one link up, or only links from nodes below: then links are as both steps leave them."""
    ends = _ways(star).groupBy("u").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return not ends.where("up > 1 or up = 1 and least = 0").limit(1).count()
