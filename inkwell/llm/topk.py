"""Exact top-k by inner product: columnar branch and bound.

Candidates stand in vertical layout, one column a dimension. For a small group
of queries, inner products grow dimension block by dimension block. What the
remaining dimensions can add to a pair is bounded by the product of the two
remaining lengths (Cauchy-Schwarz). A candidate that can no longer reach the
k-th best score of any query of the group leaves the columns; once few pairs
are left, they alone are followed, pair by pair. The k-th best score of a
sample of the candidates, which the whole can only raise, is the first bound.
All scores are integers, so ties are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, need

#: Queries bounded together, dimensions of a block, candidates of a block.
QUERY_GROUP, DIMENSION_BLOCK, CANDIDATE_BLOCK = 32, 8, 4096
#: Bytes of query vectors that are sent to the executors at once, about.
ROUND_BYTES = 32 << 20
#: Numbers of the candidates that give the first bounds: so many values at most, about.
SEED_VALUES = 1 << 18
#: Candidates leave the columns if fewer than the first share stay; pairs are followed singly below the second.
COMPACT_SHARE, PAIR_SHARE = 0.8, 0.25


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors that take part. Null ones, empty ones, and those with a null or a value that isn't finite do not."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).alias("id"), v.cast("array<double>").alias("v")).where(v.isNotNull() & (F.size(v) > 0) & ~odd & F.col(id_col).isNotNull())


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's k best candidates, or all if there are fewer.

    A component x counts as floor(``scale`` * x). A query is no candidate of its
    own: a candidate of the query's id is left out. Ties go to the smaller id.
    Only vectors of one length meet. Vectors that :func:`usable` leaves out take
    no part; a repeated candidate is found as often, a repeated query answered
    once, and two queries of one id and different vectors each get their rows.
    No queries or no candidates give no rows. Other columns are not read.

    Queries are taken in rounds of ``ROUND_BYTES``, each sent to every executor
    for one scan of the candidates, which are never shuffled. A task returns
    those of its k best a query that reach the query's first bound.
    """
    need(queries, id_col, vector_col)
    need(candidates, id_col, vector_col)
    spark, tables = queries.sparkSession, Tables(queries.sparkSession)
    there = usable(candidates, id_col, vector_col)
    asked = _bounded(usable(queries, id_col, vector_col).distinct(), there, k, scale)
    asked = tables.write(asked)
    values = asked.agg(F.sum(F.size("v"))).first()[0] or 0
    rounds = max(1, -(-values * 8 // ROUND_BYTES))
    asked = asked.withColumn("round", F.pmod(F.xxhash64("id", "v"), F.lit(rounds)))
    found = None
    for b in range(rounds):
        rows = asked.where(F.col("round") == b).orderBy("near", "id", "v").select("id", "v", "least").collect()
        shipped = spark.sparkContext.broadcast([(r[0], np.floor(scale * np.array(r[1])), r[2]) for r in rows])
        part = tables.write(there.mapInArrow(_searcher(shipped, k, scale), "query_id long, copy int, vec_id long, score long"))
        shipped.unpersist()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id", "copy").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _bounded(asked: DataFrame, there: DataFrame, k: int, scale: float) -> DataFrame:
    """(id, v, least, near): the k-th best score among sampled candidates (null if there are fewer), and the id of the best one.

    Queries of one nearest candidate are like each other, so they are grouped.
    """
    spark = asked.sparkSession
    count, values = there.agg(F.count("*"), F.sum(F.size("v"))).first()
    share = min(1.0, SEED_VALUES / (values or 1))
    draw = F.pmod(F.xxhash64("id", F.lit("seed")), F.lit(1_000_000)) < int(share * 1_000_000)
    sample = [(r[0], np.floor(scale * np.array(r[1]))) for r in (there.where(draw).orderBy("id", "v").collect() if count else [])]
    shipped = spark.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list] = {}
        for i, v in shipped.value:
            by_size.setdefault(len(v), []).append((i, v))
        stacked = {n: (np.array([i for i, _ in rows]), np.stack([v for _, v in rows])) for n, rows in by_size.items()}
        for batch in batches:
            least, near = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.floor(scale * v.values.to_numpy(zero_copy_only=False))
                ids, vectors = stacked.get(len(v), (np.empty(0, np.int64), np.empty((0, len(v)))))
                other = ids != i
                scores = vectors[other] @ v
                least.append(float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None)
                near.append(int(ids[other][scores.argmax()]) if len(scores) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.float64()), pa.array(near, pa.int64())], ["id", "v", "least", "near"])

    return asked.mapInArrow(run, "id long, v array<double>, least double, near long")


def _searcher(shipped, k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, Search] = {}
        sizes: dict[int, list] = {}
        copies: Counter = Counter()
        for i, v, least in shipped.value:
            sizes.setdefault(len(v), []).append((i, copies[i], v, -np.inf if least is None else least))
            copies[i] += 1
        for n, rows in sizes.items():
            ids, copy, stacked, least = zip(*rows, strict=True)
            by_size[n] = Search(np.array(ids), np.array(copy, np.int32), np.stack(stacked), k, np.array(least))
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            lengths = vectors.value_lengths().to_numpy()
            for n in np.unique(lengths):
                if n in by_size:
                    at = np.flatnonzero(lengths == n)
                    for a in range(0, len(at), CANDIDATE_BLOCK):
                        rows = at[a : a + CANDIDATE_BLOCK]
                        flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                        by_size[n].add(ids[rows], np.floor(scale * flat.reshape(-1, n)))
        for search in by_size.values():
            yield search.result()

    return run


class Search:
    """The k best candidates so far of some queries that reach the queries' first bounds ``least``."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None) -> None:
        # the dimensions with most mass come first: they decide soonest
        self.order = np.argsort(-np.square(vectors).sum(axis=0), kind="stable")
        self.ids, self.copies, self.k = ids, copies, k
        self.vectors = vectors[:, self.order]
        self.cuts = list(range(0, vectors.shape[1], DIMENSION_BLOCK)) + [vectors.shape[1]]
        self.rest = self._remaining(self.vectors)
        self.least = np.full(len(ids), -np.inf) if least is None else least
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        #: pairs that each dimension block was computed for; all pairs in the first
        self.computed = np.zeros(len(self.cuts) - 1, np.int64)

    def _remaining(self, vectors: np.ndarray) -> np.ndarray:
        """Length of what is left of each vector from each cut on, a row a cut."""
        return np.stack([np.sqrt(np.square(vectors[:, c:]).sum(axis=1)) for c in self.cuts])

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        columns = np.ascontiguousarray(vectors[:, self.order].T)
        rest = self._remaining(columns.T)
        for g in range(0, len(self.ids), QUERY_GROUP):
            self._add(slice(g, g + QUERY_GROUP), ids, columns, rest)

    def _add(self, group: slice, ids: np.ndarray, columns: np.ndarray, rest: np.ndarray) -> None:
        queries, mine = self.vectors[group], self.rest[:, group]
        least = np.maximum(self.least[group], self.scores[group, -1])
        partial, row, col = np.zeros((len(queries), len(ids))), None, None
        for i, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            self.computed[i] += partial.size
            more = i + 2 < len(self.cuts)
            if row is None:
                partial += queries[:, a:b] @ columns[a:b]
                # a unit more than rounding can take; ties must survive
                bound = mine[i + 1][:, None] * rest[i + 1] * (1 + 1e-9) + 1 if more else 0
                alive = partial + bound >= least[:, None]
                if not more or alive.mean() < PAIR_SHARE:
                    row, col = np.nonzero(alive)
                    partial = partial[row, col]
                elif (keep := alive.any(axis=0)).mean() < COMPACT_SHARE:
                    ids, columns, rest, partial = ids[keep], columns[:, keep], rest[:, keep], partial[:, keep]
            else:
                partial += np.einsum("pd,dp->p", queries[row, a:b], columns[a:b, col])
                bound = mine[i + 1][row] * rest[i + 1][col] * (1 + 1e-9) + 1 if more else 0
                alive = partial + bound >= least[row]
                row, col, partial = row[alive], col[alive], partial[alive]
            if not partial.size:
                return
        other = ids[col] != self.ids[group][row]
        row, col, partial = row[other], col[other], partial[other]
        start = np.searchsorted(row, np.arange(len(queries) + 1))  # nonzero gives rows in order
        for k in np.flatnonzero(np.diff(start)).tolist():
            at, q = slice(start[k], start[k + 1]), group.start + k
            scores, found = np.concatenate([self.scores[q], partial[at]]), np.concatenate([self.found[q], ids[col[at]]])
            best = np.lexsort((found, -scores))[: self.k]
            self.scores[q], self.found[q] = scores[best], found[best]

    def result(self) -> pa.RecordBatch:
        full = self.scores > -np.inf
        q, copy = (np.broadcast_to(x[:, None], full.shape)[full] for x in (self.ids, self.copies))
        return pa.RecordBatch.from_arrays(
            [pa.array(q), pa.array(copy), pa.array(self.found[full]), pa.array(self.scores[full].astype(np.int64))],
            ["query_id", "copy", "vec_id", "score"],
        )
