"""Generalised pigeonhole search in Hamming space over fingerprints of one or more longs.

With the bits in m groups and a threshold t_i (-1 or more) for each, whose sum
is tau - m + 1, two fingerprints within tau bits differ in at most t_i bits of
some group i. So it is enough to look, group by group, among the fingerprints
whose bits of that group differ in at most t_i places, and to verify those.

* Correlated bits share a group: what one of them tells, the others repeat, so
  apart they would weaken several groups instead of one.
* The thresholds are unequal. A dynamic programme takes those of least cost,
  where the cost is the rows probed plus the candidates expected. The expected
  candidates come from a tree-shaped model of each group's bits (the strongest
  pairwise dependencies of *all* fingerprints), which gives the distribution
  of the group's distance between two fingerprints.
* A bucket that is too large for one task is dealt out as a grid of cells.
* A cell returns a spanning forest of its links, never all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Cost of a row dealt out and of a candidate compared, in the same unit.
ROW_COST, PAIR_COST = 1.0, 0.01
#: For fewer fingerprints than these, rows cost as if there were so many: their plan's size counts, too.
FEW = 1000
#: Members of a bucket that one task compares; larger buckets become a grid.
CELL = 1024


@dataclass(frozen=True)
class Plan:
    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]

    def probes(self, words: int) -> list[tuple[int, ...]]:
        """(group, then for each word: mask, flipped bits, highest flipped bit), as signed longs."""
        rows = []
        for g, (bits, most) in enumerate(zip(self.groups, self.thresholds, strict=True)):
            for r in range(most + 1):
                for flip in combinations(sorted(bits), r):
                    row = [g]
                    for w in range(words):
                        row += [_word(bits, w), _word(flip, w), _word(flip[-1:], w)]
                    rows.append(tuple(row))
        return rows


def _word(bits: tuple[int, ...], word: int) -> int:
    x = sum(1 << (b - 64 * word) for b in bits if b // 64 == word)
    return x - (1 << 64) if x >> 63 else x


# --- statistics --------------------------------------------------------------


def bit_statistics(fps: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """How many fingerprints there are and how often bits i and j are both set.

    Covers every row; a task returns one row a bit, whatever it has read.
    """
    width = 64 * len(columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, rows = np.zeros((width, width)), 0
        for batch in batches:
            x = np.concatenate([_bits(c.to_numpy(zero_copy_only=False)) for c in batch.columns], axis=1).astype(np.float32)
            both += x.T @ x
            rows += len(x)
        cells = {f"c{j}": both[:, j].astype(np.int64) for j in range(width)}
        yield pa.RecordBatch.from_pydict({"bit": np.arange(width), "n": np.full(width, rows), **cells})

    schema = "bit long, n long, " + ", ".join(f"c{j} long" for j in range(width))
    counted = fps.select(*columns).mapInArrow(count, schema)
    rows = counted.groupBy("bit").agg(F.sum("n"), *[F.sum(f"c{j}") for j in range(width)]).collect()
    both = np.zeros((width, width))
    for row in rows:
        both[row[0]] = row[2:]
    return (int(rows[0][1]) if rows else 0), both


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def joint_laws(n: int, both: np.ndarray) -> np.ndarray:
    """law[i, j, x, y]: how likely bit i is x and bit j is y (with one half added to each count)."""
    one = np.diag(both)
    law = np.empty((*both.shape, 2, 2))
    law[..., 1, 1] = both
    law[..., 1, 0] = one[:, None] - both
    law[..., 0, 1] = one[None, :] - both
    law[..., 0, 0] = n - one[:, None] - one[None, :] + both
    law = np.maximum(law, 0) + 0.5
    law /= law.sum(axis=(2, 3), keepdims=True)
    for i in range(len(both)):
        p = law[i, i, 1].sum()
        law[i, i] = [[1 - p, 0], [0, p]]
    return law


def information(law: np.ndarray) -> np.ndarray:
    """Mutual information of each two bits."""
    a, b = law.sum(axis=3, keepdims=True), law.sum(axis=2, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nansum(np.where(law > 0, law * np.log(law / (a * b)), 0), axis=(2, 3))


def group_bits(info: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """m groups of equal size: each takes the most dependent free pair, then what depends most on it."""
    width, groups = len(info), []
    free = np.ones(width, bool)
    for g in range(m):
        size = width // m + (g < width % m)
        pairs = np.where(free[:, None] & free[None, :] & ~np.eye(width, dtype=bool), info, -1.0)
        group = [int(x) for x in np.unravel_index(int(pairs.argmax()), pairs.shape)][:size]
        free[group] = False
        while len(group) < size:
            b = int(np.where(free, info[:, group].sum(axis=1), -1.0).argmax())
            group.append(b)
            free[b] = False
        groups.append(tuple(sorted(group)))
    return tuple(groups)


def distance_law(law: np.ndarray, info: np.ndarray, group: tuple[int, ...], most: int) -> np.ndarray:
    """P(two fingerprints differ in at most r bits of the group), for r up to ``most``.

    The bits follow the tree of strongest dependencies; a message up the tree
    is one polynomial in the number of differing bits for each pair of values.
    """
    children: dict[int, list[int]] = {b: [] for b in group}
    order, outside = [group[0]], list(group[1:])
    while outside:
        part = info[np.ix_(order, outside)]
        i, j = (int(x) for x in np.unravel_index(int(part.argmax()), part.shape))
        children[order[i]].append(outside[j])
        order.append(outside.pop(j))
    size = most + 1
    message: dict[int, np.ndarray] = {}
    for node in reversed(order):
        poly = np.zeros((2, 2, size))
        for x in (0, 1):
            for y in (0, 1):
                at = int(x != y)
                if at < size:
                    poly[x, y, at] = 1
        for child in children[node]:
            given = law[node, child] / law[node, child].sum(axis=1, keepdims=True)
            below = np.einsum("xu,yv,uvk->xyk", given, given, message[child])
            poly = np.stack([[np.convolve(poly[x, y], below[x, y])[:size] for y in (0, 1)] for x in (0, 1)])
        message[node] = poly
    root = np.diag(law[group[0], group[0]])
    return np.cumsum(np.einsum("x,y,xyk->k", root, root, message[group[0]]))


def allocate(costs: list[list[float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Least cost with thresholds adding up to ``total``; costs[i][t + 1] is that of threshold t in group i."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for group in costs:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for have, (cost, chosen) in best.items():
            for t in range(-1, len(group) - 1):
                key, value = have + t, (cost + group[t + 1], (*chosen, t))
                if key not in step or value < step[key]:
                    step[key] = value
        best = step
    return best[total]


def make_plan(n: int, both: np.ndarray, tau: int) -> Plan:
    """The number of groups and the thresholds of least expected cost for n fingerprints."""
    law = joint_laws(n, both)
    info = information(law)
    plans = []
    for m in range(max(1, len(both) // 40), tau + 2):  # of more bits than 40, a group is as good as all
        groups = group_bits(info, m)
        costs = []
        for group in groups:
            near = distance_law(law, info, group, tau)
            rows, cost = 0, [0.0]
            for t in range(tau + 1):
                flips = _choose(len(group), t)
                rows += flips if t == 0 else flips / 2  # one of two finds the other
                # beyond 5000 rows a fingerprint no plan is of use
                cost.append(max(n, FEW) * rows * ROW_COST + n * n / 2 * near[t] * PAIR_COST if rows <= 5000 else float("inf"))
            costs.append(cost)
        cost, thresholds = allocate(costs, tau - m + 1)
        plans.append((cost, Plan(groups, thresholds)))
    return min(plans, key=lambda p: p[0])[1]


def _choose(n: int, k: int) -> float:
    out = 1.0
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return out


# --- probe and verify --------------------------------------------------------


def near_links(
    fps: DataFrame, tau: int, columns: list[str] | None = None, plan: Plan | None = None, cell: int = CELL, nearest: bool = False, accept: int | None = None
) -> DataFrame:
    """Links (a, b) that connect whatever chains of distance ``tau`` or less connect.

    ``fps`` has distinct longs in ``node`` and fingerprints in ``columns``
    (``node`` itself if none are named). Two fingerprints within tau are in one
    component of the result, but need not be a row of it: each bucket returns a
    spanning forest. With ``nearest`` that is the forest of the shortest links,
    which also connects whatever chains of any smaller distance do. Candidates
    that a bucket brings together are links up to distance ``accept``, if that
    is more than tau; there is no promise to find those beyond tau.
    """
    columns = columns or ["node"]
    if plan is None:
        n, both = bit_statistics(fps, columns)
        if not n:
            return fps.sparkSession.createDataFrame([], "a long, b long")
        plan = make_plan(n, both, tau)
    most = max(tau, accept or 0)
    probes = F.array(*[F.struct(*map(F.lit, p)) for p in plan.probes(len(columns))])
    keys = [f"key{w}" for w in range(len(columns))]
    mask, flip, top = ([F.col(f"p.col{2 + 3 * w + k}") for w in range(len(columns))] for k in range(3))
    rows = fps.where("node is not null").select("node", *columns, F.explode(probes).alias("p"))
    for w, c in enumerate(columns):
        rows = rows.where(F.col(c).bitwiseAND(top[w]) == 0)
    whole = F.lit(True)
    for f in flip:
        whole = whole & (f == 0)
    # "sides": 3 is looked up and looks up, 1 only looks up
    rows = rows.select(
        F.col("p.col1").alias("part"),
        *[F.col(c).bitwiseAND(mask[w]).bitwiseXOR(flip[w]).alias(keys[w]) for w, c in enumerate(columns)],
        F.when(whole, 3).otherwise(1).alias("sides"),
        F.struct("node", *columns).alias("f") if columns != ["node"] else F.struct("node").alias("f"),
    )
    large = cut(
        rows.groupBy("part", *keys).count().where(F.col("count") > cell)
        .select("part", *keys, F.ceil(F.col("count") / cell).cast("int").alias("grid"))
    )
    if large.limit(1).count():
        mine = F.pmod(F.xxhash64("f.node"), F.col("grid")).cast("int")
        every = F.sequence(F.lit(0), F.col("grid") - 1)

        def at(q: Column, i: Column, side: Column) -> Column:
            return F.struct(q.alias("q"), i.alias("i"), side.alias("s"))

        none = F.array().cast("array<struct<q:int,i:int,s:int>>")
        dealt = F.concat(
            F.transform(every, lambda c: at(mine, c, F.lit(1))),
            F.when(F.col("sides") == 3, F.transform(every, lambda c: at(c, mine, F.lit(2)))).otherwise(none),
        )
        cells = F.when(F.col("grid").isNull(), F.array(at(F.lit(0), F.lit(0), F.col("sides")))).otherwise(dealt)
        rows = (
            rows.join(large, ["part", *keys], "left")
            .select("part", *keys, "f", F.explode(cells).alias("c"))
            .select("part", *keys, "f", F.col("c.q").alias("q"), F.col("c.i").alias("i"), F.col("c.s").alias("sides"))
        )
    else:
        rows = rows.withColumns({"q": F.lit(0), "i": F.lit(0)})
    buckets = (
        rows.groupBy("part", *keys, "q", "i")
        .agg(
            F.collect_list(F.when(F.col("sides").bitwiseAND(1) > 0, F.col("f"))).alias("left"),
            F.collect_list(F.when(F.col("sides").bitwiseAND(2) > 0, F.col("f"))).alias("right"),
        )
        .where("size(left) > 0 and size(right) > 0 and (size(left) > 1 or size(right) > 1 or left[0].node <> right[0].node)")
        .select("left", "right")
    )
    link = nearest_forest if nearest else forest

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for (left, x), (right, y) in zip(_lists(batch.column(0)), _lists(batch.column(1)), strict=True):
                distance = np.zeros((len(left), len(right)), np.uint8)
                for u, v in zip(x, y, strict=True):
                    # unsigned: of a negative number, bitwise_count would count the absolute value
                    distance += np.bitwise_count(u.view(np.uint64)[:, None] ^ v.view(np.uint64)[None, :])
                distance[left[:, None] == right[None, :]] = 255
                found += link(left, right, distance, most)
            ends = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return buckets.mapInArrow(verify, "a long, b long")


def _lists(column: pa.ListArray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(nodes, fingerprint words) of each list; a struct of the node alone is its own fingerprint."""
    fields = [f.to_numpy(zero_copy_only=False) for f in column.values.flatten()]
    at = column.offsets.to_numpy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        parts = [f[a:b] for f in fields]
        yield parts[0], parts[1:] or parts


def forest(left: np.ndarray, right: np.ndarray, distance: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Stars that span the links of up to ``most`` between two lists of nodes, at most a link a member."""
    near = distance <= most
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return []
    if len(rows) == 1:
        return [(int(left[rows[0]]), int(x)) for x in right[near[rows[0]]]]
    edges, new_row, new_col = [], np.ones(len(left), bool), np.ones(len(right), bool)
    for start in rows.tolist():
        if not new_row[start]:
            continue
        new_row[start] = False
        root, front = int(left[start]), np.array([start])
        while len(front):
            cols = np.flatnonzero(near[front].any(axis=0) & new_col)
            new_col[cols] = False
            edges += [(root, x) for x in right[cols].tolist() if x != root]
            front = np.flatnonzero(near[:, cols].any(axis=1) & new_row) if len(cols) else cols
            new_row[front] = False
            edges += [(root, x) for x in left[front].tolist() if x != root]
    return edges


def nearest_forest(left: np.ndarray, right: np.ndarray, distance: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The shortest links that span those of up to ``most``: taken in order of length, if they join two parts."""
    row, col = np.nonzero(distance <= most)
    if not len(row):
        return []
    parts: dict[int, int] = {}

    def part(x: int) -> int:
        while (up := parts.get(x, x)) != x:
            parts[x] = x = parts.get(up, up)
        return x

    edges = []
    for k in np.argsort(distance[row, col], kind="stable").tolist():
        a, b = int(left[row[k]]), int(right[col[k]])
        if (x := part(a)) != (y := part(b)):
            parts[x] = y
            edges.append((a, b))
    return edges
