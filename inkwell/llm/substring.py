"""Removal of word sequences that an earlier document already has.

A window of ``window`` words is removed from a document if it starts in one
with a smaller id. Suffix automata of reference shards decide: documents of a
shard are taken in the order of their ids, streamed through the automaton of
those before, and then added to it; words whose matching statistic reaches the
window length end a removed span.

An automaton of everything, sent to everyone, would grow with the corpus. So
the shards hold only text that can repeat, and a document meets only the shards
that can hold its windows:

* Equal windows have the same minimiser (the least hash of their short word
  runs), so a document's windows fall into runs of one minimiser each, and
  shards are dealt by minimiser. One that a single document has needs no shard.
* Equal runs, told by a 128-bit BLAKE2b digest of their words, give equal
  results, so a shard has each run twice at most: of the smallest id, and of the
  next one, which stands for all others.
* A minimiser with more runs than a shard holds becomes a grid of reference
  shards by streams, so no task gets an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .automaton import SuffixAutomaton
from .common import Tables, cut, need, with_few

#: Words of the short runs whose least hash is a window's minimiser.
GRAM = 8
#: Runs of words in one reference shard.
SHARD = 2048
#: Ids that are broadcast to leave out other texts before a shuffle; if there are more, all texts are shuffled.
BROADCAST_IDS = 500_000
#: Distinct words of which a worker keeps the hash.
KEPT_WORDS = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and U+0009-U+000D, unchanged, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class _Hasher(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = value = xxh64_intdigest(word)
        return value


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * _BASE + hashes[i : i + n]
    out ^= out >> np.uint64(29)
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, by doubling."""
    n, size = len(values) - width + 1, 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size : width - size + n])


def window_runs(words: list[bytes], window: int, hasher: dict) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(minimiser, digest of the run's words, first window, windows) of each run of windows with one minimiser."""
    if len(words) < window:
        none = np.empty(0, np.int64)
        return none, [], none, none
    gram = min(GRAM, window)
    hashes = np.fromiter((hasher[w] for w in words), np.uint64, len(words))
    least = _least(_rolled(hashes, gram), window - gram + 1)
    start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    end = np.concatenate((start[1:], [len(least)]))
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digests = [hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(starts[start].tolist(), ends[end + window - 2].tolist(), strict=True)]
    return least[start].view(np.int64), digests, start, end - start


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Tables]:
    """Columns ``id_col``, ``n_words``, ``n_removed``, ``kept`` (binary), ``kept_sha256``; one row a row of ``docs``.

    ``kept`` is null where nothing was removed (the text has all of it). Null
    and empty texts have no words; texts of any length are taken whole. A window
    is judged on the input, not on what is left elsewhere. Rows that share an id are no reference for each other. A
    row whose id is null keeps all its words and is no reference. Other columns
    are not read; an empty table gives no rows. The second value holds the
    tables in the shared folder, to be dropped when the result is written.
    """
    need(docs, id_col, text_col)
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    kind = texts.schema["doc"].dataType.simpleString()
    run_type = "array<struct<m:bigint,d:binary,at:int,n:int>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            count, sha, sizes, parts = [], [], [], []
            for doc, text in zip(batch.column(0), batch.column(2), strict=True):
                words = words_of(text.as_py())
                count.append(len(words))
                sha.append(_digest(words))
                runs = window_runs(words if doc.is_valid else [], window, hasher)
                sizes.append(len(runs[0]))
                parts.append(runs)
            m, at, n = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
            digests = pa.array([d for p in parts for d in p[1]], pa.binary())
            rows = pa.StructArray.from_arrays(
                [pa.array(m), digests, pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["m", "d", "at", "n"]
            )
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(sha), pa.ListArray.from_arrays(offsets, rows)],
                ["doc", "row", "n_words", "sha", "runs"],
            )

    scanned = tables.write(texts.mapInArrow(scan, f"doc {kind}, row long, n_words long, sha string, runs {run_type}"))
    runs = scanned.select("doc", "row", F.explode("runs").alias("r")).select("doc", "row", "r.*")
    shared = runs.groupBy("m").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("m")
    runs = tables.write(runs.join(shared, "m"))

    # a run is of its smallest id (role 1) or of a larger one (role 2); each role is streamed once
    keepers = runs.groupBy("m", "d").agg(F.min("doc").alias("keeper"))
    runs = tables.write(runs.join(keepers, ["m", "d"]).withColumn("role", F.when(F.col("doc") > F.col("keeper"), 2).otherwise(1)).drop("keeper"))
    one = runs.groupBy("m", "d", "role").agg(F.min(F.struct("doc", "row", "at", "n")).alias("o"))
    one = tables.write(one.select("m", "d", "role", "o.*"))
    several = one.groupBy("m").count().where("count > 1").select("m", F.ceil(F.col("count") / SHARD).cast("int").alias("grid"))
    wanted = with_few(one, cut(several), ["m"])
    per_doc = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("m", "d", "role", "at", "n", "grid")).alias("runs"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, wanted_runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                for r in wanted_runs:
                    part = b" ".join(words[r["at"] : r["at"] + r["n"] + window - 1])
                    out.append((doc, r["m"], r["d"], r["role"], r["grid"], part))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [batch.schema.field(0).type, pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc", "m", "d", "role", "grid", "words"])

    found = _with_texts(texts, per_doc).select("doc", "text", "runs").mapInArrow(
        segments, f"doc {kind}, m long, d binary, role int, grid int, words binary"
    )
    mine, every = F.pmod(F.xxhash64("d", "role"), F.col("grid")).cast("int"), F.sequence(F.lit(0), F.col("grid") - 1)
    cell = lambda q, i, side: F.struct(q.alias("q"), i.alias("i"), F.lit(side).alias("side"))
    cells = F.when(F.col("grid") == 1, F.array(cell(F.lit(0), F.lit(0), 3))).otherwise(
        F.concat(F.transform(every, lambda c: cell(mine, c, 1)), F.transform(every, lambda c: cell(c, mine, 2)))
    )
    shards = (
        found.withColumn("c", F.explode(cells))
        .groupBy("m", "c.q", "c.i")
        .agg(F.collect_list(F.struct("doc", "c.side", "words", "m", "d", "role")).alias("members"))
        .select("members")
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [hit for members in batch.column(0) for hit in shard_hits(members.as_py(), window)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["m", "d", "role", "off", "windows"])

    streamed = tables.write(shards.mapInArrow(stream, "m long, d binary, role int, off int, windows int"))
    # what is found in a run holds wherever its document, or in its stead any later one, has it
    matched = runs.drop("n").join(streamed, ["m", "d", "role"]).select("doc", "row", (F.col("at") + F.col("off")).alias("at"), F.col("windows").alias("n"))
    hits = tables.write(
        matched.groupBy("doc", "row").agg(F.collect_list(F.struct("at", "n")).alias("hits"))
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept, sha = [], [], []
            for text, spans in zip(batch.column(2), batch.column(3), strict=True):
                words = words_of(text.as_py())
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans.as_py():
                    edge[s["at"]] += 1
                    edge[s["at"] + s["n"] + window - 1] -= 1
                left = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
                sha.append(_digest(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha)],
                ["doc", "row", "n_removed", "kept", "kept_sha"],
            )

    cleaned = _with_texts(texts, hits).select("doc", "row", "text", "hits").mapInArrow(
        keep, f"doc {kind}, row long, n_removed long, kept binary, kept_sha string"
    )
    result = scanned.drop("runs").join(cleaned, ["doc", "row"], "left").select(
        F.col("doc").alias(id_col),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        "kept",
        F.coalesce("kept_sha", "sha").alias("kept_sha256"),
    )
    return result, tables


def _with_texts(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """``lists`` with one text for each (doc, row); texts without a list are left out before the shuffle if that is cheap."""
    keys = lists.select("doc", "row")
    if keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(keys), ["doc", "row"], "left_semi")
    return texts.dropDuplicates(["doc", "row"]).join(lists, ["doc", "row"])


def shard_hits(members: list[dict], window: int) -> list[tuple]:
    """(m, d, role, first window in the run, windows) that occur in a member with a smaller id.

    ``side`` 1 is streamed, 2 is reference, 3 is both.
    """
    out, automaton = [], SuffixAutomaton()
    members = sorted(members, key=lambda r: r["doc"])
    at = 0
    while at < len(members):
        end = at
        while end < len(members) and members[end]["doc"] == members[at]["doc"]:
            end += 1
        split = [r["words"].split(b" ") for r in members[at:end]]
        for r, words in zip(members[at:end], split, strict=True):
            if r["side"] & 1 and len(automaton.step) > 1:
                out += [(r["m"], r["d"], r["role"], first, n) for first, n in spans(automaton.statistics(words), window)]
        for r, words in zip(members[at:end], split, strict=True):
            # a later copy adds nothing to a reference that has the run
            if r["side"] & 2 and r["role"] == 1:
                automaton.add(words)
        at = end
    return out


def spans(statistics: Iterator[int], window: int) -> Iterator[tuple[int, int]]:
    """(first window, windows) of each maximal stretch of words whose matching statistic is ``window`` or more."""
    first, k = None, -1
    for k, have in enumerate(statistics):
        if have >= window:
            first = k if first is None else first
        elif first is not None:
            yield first - window + 1, k - first
            first = None
    if first is not None:
        yield first - window + 1, k + 1 - first
