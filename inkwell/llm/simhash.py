"""SimHash near-duplicate groups over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Tables, cut, need, own_names, small_batches, with_few
from .components import components
from .gph import near_links
from .hashing import jaccard, simhash, wide_simhash
from .prefixes import common_shingles, crossing_pairs, parity, prefix


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (``id_col``, ``fp`` signed long) for each row of ``docs``.

    Null and empty texts, and texts of white space, have fingerprint 0. Other
    columns are not read. Texts are taken whole, one at a time.
    """
    need(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [simhash(t.as_py(), width, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def near_duplicates(
    docs: DataFrame, width: int = 4, most_bits: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Columns ``id_col``, ``fp`` (signed long), ``component_id`` for each row of ``docs``.

    Rows whose fingerprints differ in ``most_bits`` or fewer bits are linked;
    ``component_id`` is the smallest id reachable by links, the row's own
    included. Equal fingerprints are one node, so a group of copies of any size
    costs one probe. Rows without words have fingerprint 0 and link like any
    other. Repeated rows each stay; a null id stays and is nobody's
    ``component_id`` unless all ids of its component are null. An empty table
    gives no rows.
    """
    marked = cut(fingerprints(docs, width, seed, id_col, text_col))
    nodes = marked.groupBy("fp").agg(F.min(id_col).alias("first"))
    nodes = cut(nodes)
    roots = components(near_links(nodes.select(F.col("fp").alias("node")), most_bits))
    # a component's smallest id, for the fingerprints that have a link
    member = roots.select(F.col("node").alias("fp"), "root").unionByName(
        roots.select(F.col("root").alias("fp"), "root").distinct()
    )
    known = member.join(nodes, "fp")
    least = known.groupBy("root").agg(F.min("first").alias("least"))
    known = known.join(least, "root").select("fp", "least")
    # cut, so that the last join deals out both sides anew and can split a fingerprint of very many rows
    whole = cut(nodes.join(known, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return marked.join(whole, "fp", "left").select(id_col, "fp", "component_id")


#: Radius and reach of the first search among 128-bit fingerprints. They decide what it costs, not what is found.
WIDE_BITS, WIDE_ACCEPT = 15, 30


def near_copies(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", tables: Tables | None = None
) -> DataFrame:
    """Columns ``id_col``, ``row`` (hash of the text), ``component_id`` for each row of ``docs``.

    Rows are linked if the Jaccard similarity of their sets of ``width``-word
    shingles is ``similarity`` or more; all such pairs count. The nearest links
    among 128-bit SimHash fingerprints, verified on the texts, join most rows
    first. Pairs that they miss share a shingle of their prefixes
    (:mod:`.prefixes`): all pairs that may still join two groups are verified,
    too, so the groups are those of brute force whatever the fingerprints'
    plan. Rows of equal sets are one node. Rows without words (null, empty,
    white space) are linked to each other. ``component_id`` is the smallest id
    reachable; null ids and repeated rows are as in :func:`near_duplicates`. An
    empty table gives no rows. What the result is read from lies in ``tables``,
    which may be dropped when it is written.
    """
    need(docs, id_col, text_col)
    tables = tables or Tables(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(texts.select("row", "text"), width, seed))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_simhash(t.as_py(), width, seed) for t in batch.column(2)]
            words = [pa.array([f[w] for f in found], pa.int64()) for w in (0, 1)]
            node = pa.array([int(np.uint64(xxh64_intdigest(f[2].tobytes())).view(np.int64)) for f in found], pa.int64())
            size = pa.array([len(f[2]) for f in found], pa.int32())
            keys = pa.array([prefix(f[2], common.value, similarity) for f in found], pa.list_(pa.int64()))
            odd = pa.array([parity(f[2]) for f in found], pa.binary())
            names = ["doc", "row", "fp0", "fp1", "node", "size", "keys", "parity"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *words, node, size, keys, odd], names)

    with small_batches(docs.sparkSession):
        found = texts.mapInArrow(mark, f"doc {kind}, row long, fp0 long, fp1 long, node long, size int, keys array<bigint>, parity binary")
        marked = tables.write(found.withColumn("at", F.monotonically_increasing_id()))
    # a struct's null comes first, so ids that are null are put last; the long lists stay with the rows
    keep = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row", "at")).alias("keep")
    nodes = tables.write(marked.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp0", "fp1", "size")], keep))

    def verified(links: DataFrame) -> DataFrame:
        # one text for each end of a link, fetched once; a hash of the id, as ids may be null
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
        ends = ends.join(nodes, "node").select("node", F.xxhash64("keep.doc").alias("at"), F.col("keep.row").alias("row"))
        here = texts.select(F.xxhash64("doc").alias("at"), "row", "text")
        once = Tables(docs.sparkSession)
        shown = once.write(with_few(here, cut(ends), ["at", "row"]).dropDuplicates(["node"]).select("node", "text"))
        pairs = links.join(shown.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        pairs = pairs.join(shown.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                same = [jaccard(x.as_py(), y.as_py(), width) >= similarity for x, y in zip(batch.column(2), batch.column(3), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

        with small_batches(docs.sparkSession, 256):
            same = cut(pairs.mapInArrow(verify, "a long, b long"))
        once.drop()
        return same

    near = near_links(nodes.select("node", "fp0", "fp1"), WIDE_BITS, ["fp0", "fp1"], nearest=True, accept=WIDE_ACCEPT)
    links = verified(cut(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    first = components(links)
    parts = nodes.where("size > 0").join(first, "node", "left").select(F.col("keep.at").alias("at"), F.coalesce("root", "node").alias("part"))
    parted = with_few(marked.select("at", "node", "size", "keys", "parity"), cut(parts), ["at"])
    more = crossing_pairs(parted, similarity)
    roots = components(links.unionByName(verified(more))) if more.limit(1).count() else first
    member = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    known = member.join(nodes.select("node", "keep"), "node")
    least = known.groupBy("root").agg(F.min("keep.doc").alias("least"))
    known = known.join(least, "root").select("node", "least")
    whole = cut(nodes.join(known, "node", "left").select("node", F.coalesce("least", "keep.doc").alias("component_id")))
    return marked.join(whole, "node", "left").select(F.col("doc").alias(id_col), "row", "component_id")


@own_names
def drop_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group that :func:`near_copies` finds: that of the smallest id, whole and unchanged.

    Rows with a null id stay. Of rows that share the kept id within a group one
    stays.
    """
    tables = Tables(docs.sparkSession)
    found = near_copies(docs, width, similarity, id_col=id_col, text_col=text_col, tables=tables).where(F.col(id_col).isNotNull())
    found = cut(found.select(F.col(id_col), F.col("row").alias("__row"), F.col("component_id").alias("__group")))
    tables.drop()
    gone = cut(found.where(F.col(id_col) != F.col("__group")).select(id_col, "__row").distinct())
    rows = docs.withColumn("__row", F.xxhash64(text_col))
    kept = with_few(rows, gone, [id_col, "__row"], "left_anti")
    twice = found.groupBy(id_col).count().where("count > 1").select(id_col)
    if not twice.limit(1).count():
        return kept.select(*docs.columns)
    # ids that several rows have: of those in one group a row stays
    twice = cut(twice)
    repeated = with_few(kept, twice, [id_col], "left_semi").join(found.distinct(), [id_col, "__row"])
    repeated = repeated.dropDuplicates([id_col, "__group"]).select(*docs.columns)
    return with_few(kept, twice, [id_col], "left_anti").select(*docs.columns).unionByName(repeated)
