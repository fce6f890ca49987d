"""The prefix trie of all conversations, as one table of nodes.

A node is a distinct sequence of first turns. Its key is a hash of that
sequence, so parts of the corpus make their own tables of nodes (partial
tries), which are merged by key. Nothing walks a tree in memory: conversations
of any length, and nodes with any number of members or children, are rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, cut, need

#: Turns of a conversation whose hashes are summed in one task; longer conversations go on in the next bucket.
BUCKET = 4096
#: Partial tries that one round merges into one.
FANIN = 64
#: Most turns that a conversation can take from the first of its five, and the modulus of how many it takes.
FAMILY, TAKES = 5, 9

_KEY = ["k1", "k2"]


def numbered(turns: DataFrame, tables: Tables, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (conv, part, nth, role, digest, bytes), ``nth`` from 1 in the order of turns; and (conv, part, before, n, home).

    Null roles and texts are empty. Turns are ordered null first, ties by role
    and by the MD5 of the text, so that texts need not be shuffled; a text is
    known by that digest. Rows are dealt by ranges of conversation and turn: a
    long conversation lies in several parts, and ``nth`` counts within the
    part; ``before`` rows of the conversation precede it. ``home`` is the
    conversation's first part, so homes follow the order of ids. Rows with a
    null id are left out.
    """
    need(turns, id_col, turn_col, role_col, text_col)
    text = F.coalesce(text_col, F.lit(""))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
        F.unhex(F.md5(text)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("at"),
    )
    order = ["conv", "turn", "role", "digest", "at"]
    dealt = rows.repartitionByRange(*order).drop("at")
    rows = tables.write(dealt.withColumn("part", F.spark_partition_id()))
    per = rows.groupBy("conv", "part").agg(F.count("*").alias("here"))
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = cut(per.select(
        "conv", "part", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"), F.sum("here").over(whole).alias("n"), F.min("part").over(whole).alias("home"),
    ))
    inside = Window.partitionBy("conv", "part").orderBy("turn", "role", "digest")
    return rows.withColumn("nth", F.row_number().over(inside).cast("long")).drop("turn"), per


def plain(rows: DataFrame, per: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: steps (conv, home, depth, last, role, digest, bytes) and (conv, home, n)."""
    steps = rows.join(per, ["conv", "part"]).withColumn("depth", F.col("before") + F.col("nth"))
    return steps.select("conv", "home", "depth", (F.col("depth") == F.col("n")).alias("last"), "role", "digest", "bytes"), per.select("conv", "home", "n").distinct()


def grafted(rows: DataFrame, per: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`plain`, but each conversation c takes its first h turns from c - c % 5 (fewer if that has fewer), and its own after its first h.

    h is crc32 of the decimal id, modulo 9. A conversation may be left without turns.
    """
    convs = per.select("conv", "home", "n").distinct()
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).withColumn("h", F.crc32(F.col("conv").cast("string")) % TAKES)
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = cut(convs.select("conv", "home", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))
    # by conversation and part, so that a long conversation's rows stay apart
    at = per.select("conv", "part", "before").join(convs, "conv")
    own = rows.join(at, ["conv", "part"]).withColumn("nth", F.col("before") + F.col("nth")).where("nth > h")
    own = own.select("conv", "home", (F.col("nth") - F.col("h") + F.col("taken")).alias("depth"), "n", "role", "digest", "bytes")
    heads = rows.where((F.col("conv") % FAMILY == 0) & (F.col("nth") < TAKES)).join(per.select("conv", "part", "before"), ["conv", "part"])
    heads = heads.withColumn("depth", F.col("before") + F.col("nth")).where(F.col("depth") < TAKES).select(F.col("conv").alias("base"), "depth", "role", "digest", "bytes")
    heads = heads.join(convs, "base").where("depth <= taken").select("conv", "home", "depth", "n", "role", "digest", "bytes")
    steps = own.unionByName(heads)
    return steps.withColumn("last", F.col("depth") == F.col("n")).drop("n"), convs.select("conv", "home", "n")


def _keyed(steps: DataFrame) -> DataFrame:
    """``steps`` with the keys ``k1, k2`` of their node and ``p1, p2`` of its parent.

    A key is the XOR of hashes of (depth, role, text) over the turns so far,
    which can be summed in buckets; the root's is (0, 0). Two hashes make 128
    bits.
    """
    hashes = {f"h{i}": F.xxhash64(F.lit(i), "depth", "role", "digest") for i in (1, 2)}
    rows = steps.withColumns(hashes).withColumn("bucket", F.expr(f"(depth - 1) div {BUCKET}"))
    rows = rows.repartition("conv", "bucket")
    sums = rows.groupBy("conv", "bucket").agg(*[F.bit_xor(f"h{i}").alias(f"s{i}") for i in (1, 2)])
    earlier = Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "bucket", *[F.coalesce(F.bit_xor(f"s{i}").over(earlier), F.lit(0)).alias(f"s{i}") for i in (1, 2)])
    inside = Window.partitionBy("conv", "bucket").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"x{i}": F.bit_xor(f"h{i}").over(inside) for i in (1, 2)}).join(sums, ["conv", "bucket"])
    keys = {f"k{i}": F.col(f"x{i}").bitwiseXOR(F.col(f"s{i}")) for i in (1, 2)}
    return rows.withColumns(keys).withColumns({f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"h{i}")) for i in (1, 2)})


def _ends(rows: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of the nodes where conversations end: ``rows(k1, k2, home, conv)``.

    A part's ids make one string a node; the strings follow each other in the
    order of parts, which is that of ids, through one running hash. A task holds
    a part's ids of a node at most, however many members a node has.
    """
    pieces = rows.groupBy(*_KEY, "home").agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    pieces = pieces.select(*_KEY, "home", F.array_join("ids", ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, done = None, None, []
        for batch in batches:
            for k1, k2, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k1, k2) == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node:
                    done.append((*node, sha.hexdigest()))
                node, sha = (k1, k2), hashlib.sha256(ids.encode())
            yield _rows(done)
            done = []
        if node:
            yield _rows([(*node, sha.hexdigest())])

    ordered = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "home").select(*_KEY, "ids")
    return ordered.mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def _rows(done: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(schema)], schema=schema)


def _rollup(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``k1, k2`` and the sums of ``values`` over the subtrees of ``nodes(k1, k2, p1, p2, depth)``, for nodes that have children.

    Bottom up by doubling: after round i every node knows the sum of what is
    less than 2^i below it, and hands it to its ancestor 2^i above. Depth d takes
    log2(d) rounds, each over the nodes that have such an ancestor only.
    """
    up = cut(nodes.where("depth > 0").select(*_KEY, F.col("p1").alias("a1"), F.col("p2").alias("a2"), "depth", *values))
    parts, reach = [], 1
    while True:
        below = cut(up.groupBy("a1", "a2").agg(*[F.sum(v).alias(f"{v}_below") for v in values]))
        parts.append(below.select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), *[F.col(f"{v}_below").alias(v) for v in values]))
        reach *= 2
        deep = up.where(F.col("depth") >= reach)
        if not deep.limit(1).count():
            break
        here = below.select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), *[f"{v}_below" for v in values])
        summed = deep.join(here, _KEY, "left").select(*_KEY, "a1", "a2", "depth", *[(F.col(v) + F.coalesce(f"{v}_below", F.lit(0))).alias(v) for v in values])
        # the root is the ancestor of the nodes at just this depth; the others ask their ancestor for its own
        over = up.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        far = summed.where(F.col("depth") > reach).join(over, ["a1", "a2"]).select(*_KEY, F.col("b1").alias("a1"), F.col("b2").alias("a2"), "depth", *values)
        root = summed.where(F.col("depth") == reach).select(*_KEY, F.lit(0).cast("long").alias("a1"), F.lit(0).cast("long").alias("a2"), "depth", *values)
        up = cut(far.unionByName(root))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*_KEY).agg(*[F.sum(v).alias(v) for v in values])


def trie(steps: DataFrame, convs: DataFrame, tables: Tables) -> DataFrame:
    """The nodes of ``steps`` and ``convs``, as :func:`plain` makes them, with the columns that :func:`prefix_trie` names."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    rows = _keyed(steps).select("conv", "home", "depth", "last", "bytes", *_KEY, "p1", "p2")
    roots = convs.select("conv", "home", zero.alias("depth"), (F.col("n") == 0).alias("last"), zero.alias("bytes"), *[zero.alias(k) for k in _KEY], none.alias("p1"), none.alias("p2"))
    rows = tables.write(rows.unionByName(roots))
    nodes = rows.select("depth", *_KEY, "p1", "p2", "bytes", F.lit(1).cast("long").alias("n_convs"), F.col("conv").alias("conv_id"), F.col("home").alias("part"))
    parts = (convs.agg(F.max("home")).first()[0] or 0) + 1

    def merged(tables_of_nodes: DataFrame, part: Column) -> DataFrame:
        fields = [F.first(c).alias(c) for c in ("depth", "p1", "p2", "bytes")]
        return tables_of_nodes.groupBy(*_KEY, part.alias("part")).agg(*fields, F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))

    while True:
        parts = -(-parts // FANIN)
        nodes = merged(nodes, F.expr(f"part div {FANIN}"))
        if parts == 1:
            break
    nodes = cut(nodes.drop("part"))
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, _KEY, "left").withColumns({
        "n_children": F.coalesce("n_children", zero), "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes"),
    }))
    below = _rollup(nodes, ["n_leaves", "saved"]).select(*_KEY, F.col("n_leaves").alias("leaves_below"), F.col("saved").alias("saved_below"))
    parents = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # the parent first, in a stage of its own that can be split where one parent has very many children
    found = cut(nodes.join(parents, ["p1", "p2"], "left").drop("p1", "p2", "bytes"))
    found = found.join(below, _KEY, "left").join(_ends(rows.where("last").select(*_KEY, "home", "conv")), _KEY, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.coalesce("leaves_below", zero)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("saved_below", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(
    turns: DataFrame, graft: bool = False, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tables: Tables | None = None
) -> DataFrame:
    """One row for each distinct sequence of a conversation's first turns (role, text), the empty one included.

    ``conv_id`` is the smallest conversation that starts with it (a member),
    ``depth`` its length, ``parent_conv_id`` the parent's ``conv_id`` (null for
    the root), ``n_convs`` its members, ``n_children`` and ``n_leaves`` the nodes
    just below and the childless ones in its subtree, itself included;
    ``saved_tokens`` the bytes of last turns that a subtree's members share with
    a smaller member; ``ends_sha256`` the hash of the comma-joined ids that end
    here. With ``graft``, conversations are rebuilt first (:func:`grafted`).

    Turns are ordered null first, ties by role and digest; repeated rows are
    turns of their own; null roles and texts are empty; rows with a null id are
    left out; an empty table gives no node, not even a root. Other columns are
    not read. What the result is read from lies in ``tables``.
    """
    tables = tables or Tables(turns.sparkSession)
    rows, per = numbered(turns, tables, id_col, turn_col, role_col, text_col)
    return trie(*(grafted if graft else plain)(rows, per), tables)
