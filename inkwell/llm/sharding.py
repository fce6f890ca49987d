"""Sharding by balanced label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, cut, need, own_names, with_few
from .running import spread_key, with_running

#: Rounds of propagation at most; it ends when nobody moves. Every move takes rows to the larger part of their group, so it does end.
ROUNDS = 100


@own_names
def shard(
    docs: DataFrame, shards: int = 16, seed: str = "shard-1", rounds: int = ROUNDS,
    id_col: str = "doc_id", text_col: str = "text", whole: bool = False,
) -> DataFrame:
    """Columns ``id_col``, ``row`` (a hash), ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, one row a row of ``docs``.

    With ``whole``, all columns of ``docs`` and then the last six of these
    names (columns of ``docs`` with such a name are replaced); ``row`` is then a
    hash of the whole row, by which places and rows meet again. Otherwise it is
    one of the text, and other columns are not read.

    The law is ``rows``: numbers of rows are at most one apart. ``slot`` counts
    a shard's rows from 0. ``size`` is the text's UTF-8 bytes plus 1 (null: 1;
    its CRC-32 is 0, as that of an empty text). Rows of equal texts are linked
    to each other; null texts are linked to nothing. Repeated rows are rows of
    their own. A null id is placed like an empty one. Texts of any length are
    read once. An empty table gives no rows. ``grown_shard`` is null.

    Every row starts in a seeded shard. In each round the linked rows of the
    smaller parts of a group move to the shard with room that most of their
    neighbours are in, as far as the room goes; so a group larger than a shard
    fills one after the other. Rows of a group are alike to its others, so the labels are counts by
    group and shard, and a round is a few joins of that table. Rows without
    links then fill all shards to their quotas.
    """
    need(docs, id_col, text_col)
    text = F.col(text_col)
    tables = Tables(docs.sparkSession)
    rows = tables.write(
        docs.select(
            F.col(id_col), F.xxhash64(*(docs.columns if whole else [text])).alias("row"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"),
            F.when(text.isNotNull(), F.xxhash64(text)).alias("g"),
            spread_key(seed, F.col(id_col)).alias("order"),
        ).withColumn("first", F.pmod(F.xxhash64("order"), F.lit(shards)).cast("int"))
    )
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    counts = rows.where("g is not null").groupBy("g", F.col("first").alias("shard")).agg(F.count("*").alias("n"))
    several = counts.groupBy("g").agg(F.sum("n").alias("members")).where("members > 1").select("g")
    counts = cut(counts.join(several, "g"))
    load = _load(counts, shards)
    for _ in range(rounds):
        counts, moved = _propagate(counts, [min(quota) - x for x in load], seed)
        load = _load(counts, shards)
        if not moved:
            break
    # A seeded start can put more linked rows into a shard than it may hold: they overflow, too.
    counts, load = _unload(counts, load, quota, seed)

    # where each group's rows go: rank in the group -> shard and slot
    placed = with_running(counts.withColumn("order", spread_key(seed, F.col("g"))), ["shard"], "order", ["g"], {"slot0": "n"})
    plan = placed.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("shard", "n", "slot0"))).alias("parts"))
    groups = cut(plan.select("g"))
    linked = with_few(rows, groups, ["g"], "left_semi", salts=8)
    ranked = with_running(linked.withColumn("one", F.lit(1)), ["g"], "order", ["row"], {"rank": "one"}, plan)
    part = F.aggregate(
        "parts",
        F.struct(F.col("rank").cast("long").alias("left"), F.lit(-1).alias("shard"), F.lit(-1).cast("long").alias("slot")),
        lambda a, p: F.when(a["shard"] >= 0, a).when(
            a["left"] < p["n"],
            F.struct(a["left"].alias("left"), p["shard"].alias("shard"), (p["slot0"] + a["left"]).cast("long").alias("slot")),
        ).otherwise(F.struct((a["left"] - p["n"]).alias("left"), a["shard"].alias("shard"), a["slot"].alias("slot"))),
    )
    linked = ranked.withColumn("p", part)
    single = with_few(rows, groups, ["g"], "left_anti", salts=8).withColumn("all", F.lit(0)).withColumn("one", F.lit(1))
    single = with_running(single, ["all"], "order", ["row"], {"rank": "one"})
    room, at = F.lit(None).cast("struct<shard:int,slot:bigint>"), total - sum(load)
    for s in reversed(range(shards)):
        at -= quota[s] - load[s]
        here = F.struct(F.lit(s).cast("int").alias("shard"), (F.col("rank") - at + load[s]).cast("long").alias("slot"))
        room = F.when((F.col("rank") >= at) & (F.col("rank") < at + quota[s] - load[s]), here).otherwise(room)
    single = single.withColumn("p", room)
    names = [id_col, "row", "size", "text_crc32", F.lit("rows").alias("law")]
    names += [F.col("p.shard").alias("shard"), F.col("p.slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    places = linked.select(*names).unionByName(single.select(*names))
    if not whole:
        return places
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    key = [F.xxhash64(id_col).alias("__id"), F.xxhash64(*docs.columns).alias("__row")]
    places = places.select(F.xxhash64(id_col).alias("__id"), F.col("row").alias("__row"), *added)
    # equal rows have one text here and as many places as there are rows; the places, short rows, may be split by adaptive execution
    once = docs.select("*", *key).dropDuplicates(["__id", "__row"]).drop(*added)
    return places.join(once, ["__id", "__row"]).select(*[c for c in docs.columns if c not in added], *added)


def _load(counts: DataFrame, shards: int) -> list[int]:
    """Linked rows in each shard: as many numbers as there are shards."""
    found = dict(counts.groupBy("shard").agg(F.sum("n")).collect())
    return [found.get(s, 0) for s in range(shards)]


def _shift(counts: DataFrame, wish: DataFrame, room: list[int], seed: str) -> tuple[DataFrame, int]:
    """Moves ``wish(g, shard, to, n)`` in a seeded order as far as the shards ``to`` have room."""
    wish = cut(wish.withColumn("order", spread_key(seed, F.col("g"), F.col("shard"))))
    queue = with_running(wish, ["to"], "order", ["g"], {"ahead": "n"})
    space = F.array(*[F.lit(max(0, int(r))) for r in room])
    moves = queue.withColumn("k", F.greatest(F.lit(0), F.least(F.col("n"), F.get(space, F.col("to")) - F.col("ahead"))).cast("long"))
    moves = cut(moves.where("k > 0").select("g", "shard", "to", "k"))
    after = (
        counts.select("g", "shard", "n")
        .unionByName(moves.select("g", "shard", (-F.col("k")).alias("n")))
        .unionByName(moves.select("g", F.col("to").alias("shard"), F.col("k").alias("n")))
        .groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0")
    )
    return cut(after), moves.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]


def _propagate(counts: DataFrame, room: list[int], seed: str) -> tuple[DataFrame, int]:
    """One round: parts of a group wish to be where its largest part in a shard with room is, if that is larger than they are."""
    open_shards = [s for s, r in enumerate(room) if r > 0]
    if not open_shards:
        return counts, 0
    size = F.struct("n", (-F.col("shard")).alias("s"))
    target = counts.where(F.col("shard").isin(open_shards)).groupBy("g").agg(F.max(size).alias("best"))
    wish = counts.join(target, "g").where(size < F.col("best")).select("g", "shard", "n", (-F.col("best.s")).alias("to"))
    return _shift(counts, wish, room, seed)


def _unload(counts: DataFrame, load: list[int], quota: list[int], seed: str) -> tuple[DataFrame, list[int]]:
    """Moves what a shard holds over its quota into others with room, a shard pair at a time."""
    shards = len(load)
    for s in range(shards):
        for t in sorted(range(shards), key=lambda x: load[x] - quota[x]):
            k = min(load[s] - quota[s], quota[t] - load[t])
            if k > 0:
                wish = counts.where(F.col("shard") == s).withColumn("to", F.lit(t))
                counts, moved = _shift(counts, wish, [k if x == t else 0 for x in range(shards)], seed)
                load[s] -= moved
                load[t] += moved
    return counts, load
