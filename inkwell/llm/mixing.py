"""Mixing sources to target weights in equal-token blocks, by native operations only.

Sainte-Lague: the k-th block of a source has the quotient target / (k - 1/2),
and blocks go to the highest quotients. The highest ones are all those of at
least some divisor, and of a source that is its target over the divisor,
rounded; so each source's count is found by itself and no list of quotients is
made. Falling divisors, one a shard, cut the order of quotients into the
shards' parts: an integer quota of every source in every shard. The house size
follows from the divisors; it is not given, so shards differ by about half a
block a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, cut, need, own_names, with_few, words_apart
from .running import spread_key, with_running

#: The space between words.
APART = r"\x20\x09-\x0D"
#: A document is taken this often at most.
MOST_REPEATS = 3
#: Blocks that the smallest source with words is cut into, so that rounding stays below a hundredth.
LEAST_BLOCKS = 400
#: Shards that the quotas are given for.
SHARDS = 16
#: Primes; the first one that doesn't divide a source's number of blocks steps through them in a fixed disorder.
STEPS = (7919, 104729, 15485863, 32452843, 49979687, 67867967, 86028121, 104395301)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, target) from (key, source, source_size), one row a source.

    Sources in order of code points, null last, weigh 1, 2, 3, 1, ... and share
    the sum of all sizes; a target stops at ``MOST_REPEATS`` times the source's
    size and the excess is shared anew by weight. The sources that stop are the
    first ones by size over weight, so one pass over running sums finds them.
    """
    w = ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("long")
    weighed = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * MOST_REPEATS)
    order = Window.orderBy(F.col("most") / F.col("weight"), "key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = weighed.withColumns({
        "left": F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0)),
        "weights": F.sum("weight").over(after),
    }).withColumn("level", F.col("left") / F.col("weights"))
    # the first source that doesn't stop sets the level of all after it
    level = F.min(F.when(F.col("most") / F.col("weight") > F.col("level"), F.struct(F.col("most") / F.col("weight"), "key", "level"))).over(whole)["level"]
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * level, F.col("most").cast("double")))
    return filled.select("key", "source_size", target.alias("target"))


def block_quotas(targets: DataFrame, seed: str, shards: int = SHARDS) -> DataFrame:
    """``targets`` with the ``block`` length in words, the source's number of ``blocks``, and its ``quotas`` of blocks, one a shard.

    Shard j of P takes the quotients from P / j times the block length up to
    those that shard j - 1 began with. No source gives more than
    ``MOST_REPEATS`` times its blocks. ``quota`` is the quotas' sum; ``first``
    and ``step`` are the seeded order of the source's blocks.
    """
    whole = Window.partitionBy(F.lit(0))
    least = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(whole)
    block = F.greatest(F.lit(1), F.floor(F.coalesce(least, F.lit(1)) / LEAST_BLOCKS)).cast("long")
    found = targets.withColumn("block", block).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("block"))).cast("long"))
    most = F.floor(F.col("source_size") * MOST_REPEATS / F.col("block"))
    upto = F.transform(F.sequence(F.lit(0), F.lit(shards)), lambda j: F.least(F.floor(F.col("target") * j / (F.col("block") * shards) + 0.5), most))
    quotas = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: (F.get("upto", j) - F.get("upto", j - 1)).cast("long"))
    draw = F.conv(F.substring(spread_key(seed, F.col("key")), 1, 12), 16, 10).cast("long")
    step = F.get(F.filter(F.array(*[F.lit(p).cast("long") for p in STEPS]), lambda p: F.col("blocks") % p != 0), F.lit(0))
    return found.withColumn("upto", upto).select(
        *targets.columns, "block", "blocks", quotas.alias("quotas"), F.get("upto", F.lit(shards)).cast("long").alias("quota"),
        F.pmod(draw, F.col("blocks")).alias("first"), step.alias("step"),
    )


def mix(
    docs: DataFrame, seed: str = "mix-1", shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Columns ``id_col``, ``size``, ``source_size``, ``target``, ``taken``, ``row`` (hash of the text); one row a row of ``docs``.

    A source's documents stand in a seeded order, their words one after the
    other in equal blocks, of which the last may be short. The blocks have a
    seeded order of their own, and each shard takes its quota of them where the
    one before stopped, beginning again at the end; ``taken`` is what all shards
    take of a document, which may be a part of it or repeat it, up to three
    times. Null or empty texts have size 0 and nothing is taken. A null source
    is a source of its own, the last. A null id is placed like an empty one.
    Repeated rows count each. An empty table gives no rows. A rerun, on any
    partitioning, gives the same numbers. Other columns are not read.

    The table of sources, a row each, is sorted in one task.
    """
    need(docs, id_col, text_col, source_col)
    key = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col)))
    rows = Tables(docs.sparkSession).write(
        docs.select(
            F.col(id_col), F.col(source_col).alias("source"), key.alias("key"),
            F.size(words_apart(F.col(text_col), APART)).cast("long").alias("size"),
            F.xxhash64(text_col).alias("row"), spread_key(seed, F.col(id_col)).alias("order"),
        )
    )
    sizes = rows.groupBy("key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    placed = with_running(rows, ["key"], "order", ["size", "row"], {"begin": "size"}, block_quotas(source_targets(sizes), seed, shards))
    end, block, blocks = F.col("begin") + F.col("size"), F.col("block"), F.col("blocks")

    def words(b):
        """Words of the document in block b, as often as the block is taken."""
        turn = F.pmod((b + F.col("first")) * F.col("step"), blocks)
        times = F.floor(F.col("quota") / blocks) + (turn < F.col("quota") % blocks).cast("long")
        return times * (F.least(end, (b + 1) * block) - F.greatest(F.col("begin"), b * block))

    first, last = (F.floor(x / block).cast("long") for x in (F.col("begin"), end - 1))
    taken = F.when(F.col("size") > 0, F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda a, b: a + words(b))).otherwise(0)
    return placed.select(id_col, "size", "source_size", "target", taken.cast("long").alias("taken"), "row")


@own_names
def resample(docs: DataFrame, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: a row as often as its words are taken, rounded, which is 0 to 3 times.

    A document of parts of blocks is taken a whole number of times: the share
    that is left over is rounded up if a seeded draw of the row is below it, so
    a source's sum keeps near its target. Rows without words weigh nothing and
    stay once. Null ids and repeated rows are as in :func:`mix`; an empty table
    gives no rows. All columns are kept as they are.
    """
    found = mix(docs, seed, id_col=id_col, text_col=text_col, source_col=source_col)
    draw = F.conv(F.substring(spread_key(f"{seed}-part", F.col(id_col), F.col("row")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + draw)).cast("int")
    # equal rows are taken differently, but any of them may be: their counts add up
    counts = found.select(F.col(id_col).alias("__id"), F.col("row").alias("__row"), times.alias("__n")).groupBy("__id", "__row").agg(
        F.sum("__n").alias("__n"), F.count("*").alias("__rows")
    )
    counts = cut(counts)
    counts = counts.select(F.xxhash64("__id").alias("__key"), F.col("__row").alias("__at"), "__n", "__rows")
    rows = docs.withColumn("__at", F.xxhash64(text_col)).withColumn("__key", F.xxhash64(id_col))
    joined = with_few(rows, counts.where("__n > 0"), ["__key", "__at"])
    n = F.col("__n")
    if counts.where("__rows > 1").limit(1).count():
        # of k equal rows each gets n div k, and n mod k of them one more
        one = Window.partitionBy(id_col, "__at").orderBy(F.col(source_col))
        joined = joined.withColumn("__nth", F.row_number().over(one))
        n = F.floor(F.col("__n") / F.col("__rows")) + (F.col("__nth") <= F.col("__n") % F.col("__rows")).cast("int")
    copies = F.when(n > 0, F.sequence(F.lit(1), n.cast("int")))
    return joined.withColumn("__copy", F.explode(copies)).select(*docs.columns)
