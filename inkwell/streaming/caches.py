"""Caches with a lifetime and a capacity, as a table of operations and as a stream.

Entries expire; at capacity a write first removes the entry that expires
earliest, even where it overwrites. Both forms fold the same :class:`Cache`,
which holds its entries and an index of them by expiry.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.scans import SECOND, micros, with_segment

#: Entries of the caches of responses, of crawl rules and of resources, and the lifetime of crawl rules in seconds.
RESPONSES, CRAWL_RULES, RESOURCES, CRAWL_RULES_TTL = 100, 500, 100, 900


class Cache:
    """Entries by key; times and lifetimes are microseconds, an entry is valid up to its expiry, that moment included.

    ``entries`` maps a key to (value, expiry, place); places count first writes,
    and settle which of two entries with the same expiry is the older one.
    ``index`` is a heap of (expiry, place, key); what an overwrite leaves in it
    is skipped when it comes up.
    """

    def __init__(self, capacity: int, ttl: int, entries: dict[str, tuple] | None = None) -> None:
        self.capacity, self.ttl, self.entries = capacity, ttl, dict(entries or {})
        self.index = [(expiry, place, key) for key, (_, expiry, place) in self.entries.items()]
        heapq.heapify(self.index)
        self.places = max((e[2] for e in self.entries.values()), default=0)
        #: keys whose entries were written or removed since the last :meth:`changes`
        self.touched: set[str] = set()

    def _first(self) -> tuple | None:
        while self.index:
            expiry, place, key = self.index[0]
            entry = self.entries.get(key)
            if entry is not None and entry[1:] == (expiry, place):
                return self.index[0]
            heapq.heappop(self.index)
        return None

    def sweep(self, now: int) -> list[str]:
        """Removes what has expired, and names it."""
        gone = []
        while (first := self._first()) and first[0] < now:
            gone.append(first[2])
            self.delete(first[2])
        return gone

    def get(self, key: str, now: int) -> str | None:
        entry = self.entries.get(key)
        if entry is None:
            return None
        if entry[1] < now:
            self.delete(key)
            return None
        return entry[0]

    def has(self, key: str, now: int) -> bool:
        return key in self.entries and self.entries[key][1] >= now

    def set(self, key: str, value: str | None, now: int, ttl: int | None = None) -> str | None:
        """Writes an entry; returns the key that was valid and had to go for it."""
        self.sweep(now)
        evicted = None
        if len(self.entries) >= self.capacity and (first := self._first()):
            evicted = first[2]
            self.delete(evicted)
        place = self.entries[key][2] if key in self.entries else self.places + 1
        self.places = max(self.places, place)
        entry = (value, now + (self.ttl if ttl is None else ttl), place)
        self.entries[key] = entry
        heapq.heappush(self.index, (entry[1], place, key))
        if len(self.index) > 2 * len(self.entries) + 64:  # mostly overwritten entries
            self.index = [(e, p, k) for k, (_, e, p) in self.entries.items()]
            heapq.heapify(self.index)
        self.touched.add(key)
        return evicted

    def delete(self, key: str) -> bool:
        self.touched.add(key)
        return self.entries.pop(key, None) is not None

    def clear(self) -> None:
        self.touched |= self.entries.keys()
        self.entries, self.index = {}, []

    def changes(self) -> Iterator[tuple[str, tuple | None]]:
        """Each key touched, with its entry, or None if it has none any more."""
        for key in sorted(self.touched):
            yield key, self.entries.get(key)
        self.touched = set()


#: Operations that may come: read; write; read, and write where nothing was found; remove; remove all; look for expired ones.
OPERATIONS = ("get", "set", "fetch", "delete", "clear", "sweep")


def apply_op(cache: Cache, op: str, key: str | None, value: str | None, now: int, ttl: int | None) -> tuple:
    """(hit, found, evicted, is_new, size): what an operation on the cache does. ``is_new`` tells that a list of its keys has changed by a write."""
    hit = found = evicted = is_new = None
    cache.sweep(now)
    if op in ("get", "fetch", "set"):
        hit = cache.has(key, now)
        found = cache.get(key, now) if op != "set" else None
        if op == "set" or (op == "fetch" and not hit):
            evicted, is_new = cache.set(key, value, now, ttl), not hit
    elif op == "delete":
        hit = cache.delete(key)
    elif op == "clear":
        cache.clear()
    return hit, found, evicted, is_new, len(cache.entries)


_FOUND = "hit boolean, found string, evicted string, is_new boolean, size long"
_NAMES = ["hit", "found", "evicted", "is_new", "size"]


def _rows(ops: DataFrame, cache: str, key: str, at: str, op: str, value: str, id_col: str, ttl: str | None) -> DataFrame:
    life = F.lit(None) if ttl is None else F.col(ttl).cast("long") * SECOND
    return ops.where(F.col(at).isNotNull()).select(
        F.col(cache).cast("string").alias("cache"), F.col(id_col).alias("id"), F.col(at).cast("timestamp").alias("ts"), micros(at).alias("at"), F.col(op).alias("op"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(value).cast("string").alias("value"), life.cast("long").alias("life"),
    )


def cache_log(
    ops: DataFrame, capacity: int, ttl_seconds: int, cache: str = "cache", key: str = "key", at: str = "ts", op: str = "op", value: str = "value", id_col: str = "event_id", ttl: str | None = None,
) -> DataFrame:
    """Each of ``ops`` with what it does to its cache: (``cache``, ``id_col``, hit, found, evicted, is_new, size).

    Operations (:data:`OPERATIONS`) are taken by time, then id; ``ttl`` names a
    column of lifetimes in seconds that override ``ttl_seconds``. A null key is
    the empty one, a null cache is a cache of its own, a null time is left out;
    operations of other names change nothing. A task holds one cache's valid
    entries, ``capacity`` at most; caches are cut in time where all has expired.
    """
    if capacity < 1:
        raise ValueError("a cache holds one entry or more")
    kind, default = ops.schema[id_col].dataType.simpleString(), ttl_seconds * SECOND
    rows = _rows(ops, cache, key, at, op, value, id_col, ttl).drop("ts")
    writes = F.col("op").isin("set", "fetch")
    rows = rows.withColumn("until", F.col("at") + F.when(writes, F.coalesce("life", F.lit(default))).otherwise(0))
    rows = with_segment(rows.withColumn("k", F.coalesce(F.concat(F.lit("s"), "cache"), F.lit("n"))), "k", "at", "until", max(default, SECOND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, store = None, None
        for batch in batches:
            k, segment, now, op_, key_, value_, life = (c.to_pylist() for c in batch.columns[:7])
            out = []
            for i in range(len(k)):
                if (k[i], segment[i]) != piece:
                    piece, store = (k[i], segment[i]), Cache(capacity, default)
                out.append(apply_op(store, op_[i], key_[i], value_[i], now[i], life[i]))
            types = (pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[7:], *[pa.array([o[j] for o in out], t) for j, t in enumerate(types)]], [cache, id_col, *_NAMES])

    ordered = rows.repartition("k", "segment").sortWithinPartitions("k", "segment", "at", "id")
    ordered = ordered.select("k", "segment", "at", "op", "key", "value", "life", F.col("cache").alias(cache), F.col("id").alias(id_col))
    return ordered.mapInArrow(run, f"`{cache}` string, `{id_col}` {kind}, {_FOUND}")


class CacheProcessor(StatefulProcessor):
    """A cache of each group in the state store: entries in a map, the time reached in a value, and a timer at the earliest expiry.

    The index by expiry is built from the entries, ``capacity`` at most, when
    operations of the group come; only entries that changed are written back.
    """

    def __init__(self, capacity: int, ttl: int) -> None:
        self.capacity, self.ttl = capacity, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "value string, expiry long, place long")
        self.reached = handle.getValueState("reached", "at long")

    def _open(self) -> Cache:
        return Cache(self.capacity, self.ttl, {key[0]: tuple(entry) for key, entry in self.entries.iterator()} if self.entries.exists() else {})

    def _save(self, cache: Cache) -> None:
        for key, entry in cache.changes():
            if entry is not None:
                self.entries.updateValue((key,), entry)
            elif self.entries.exists() and self.entries.containsKey((key,)):
                self.entries.removeKey((key,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if first := cache._first():
            self.handle.registerTimer(first[0] // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cache, reached = self._open(), (self.reached.get() or (0,))[0] if self.reached.exists() else 0
        for r in sorted(rows, key=lambda r: (r.at, r.id)):
            reached = max(reached, r.at)
            yield Row(cache=key[0], id=r.id, **dict(zip(_NAMES, apply_op(cache, r.op, r.key, r.value, reached, r.life), strict=True)))
        self._save(cache)
        self.reached.update((reached,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        cache = self._open()
        cache.sweep(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._save(cache)
        if not cache.entries:
            self.reached.clear()
        return iter(())

    def close(self) -> None:
        pass


def cache_op_stream(
    ops: DataFrame, capacity: int, ttl_seconds: int, cache: str = "cache", key: str = "key", at: str = "ts", op: str = "op", value: str = "value", id_col: str = "event_id", ttl: str | None = None,
    late: str = "1 minute",
) -> DataFrame:
    """:func:`cache_log` of a stream, in which a cache's state outlives its queries' restarts.

    Operations of a batch are taken by time; one that comes late is judged at
    the time its cache has reached. Timers of event time, which trails by
    ``late``, remove what has expired. Needs the RocksDB state store.
    """
    rows = _rows(ops, cache, key, at, op, value, id_col, ttl).withWatermark("ts", late)
    kind = ops.schema[id_col].dataType.simpleString()
    return rows.groupBy("cache").transformWithState(CacheProcessor(capacity, ttl_seconds * SECOND), f"cache string, id {kind}, {_FOUND}", "append", "eventTime")


def lookups(requests: DataFrame, responses: DataFrame, ttl_seconds: int, key: str = "key", at: str = "ts", response: str = "response_id") -> DataFrame:
    """``requests`` with ``found`` (the key's last ``response`` by then, if it isn't too old), ``age_us`` of that last one, and ``verdict``: hit, expired or miss.

    An as-of join without a join: both tables are one, and each request takes
    what was last before it, so no request is multiplied and no key's rows meet.
    A response of the request's own time counts. Null keys and times are misses.
    """
    from ..operators.scans import latest_before

    asked = requests.withColumn("_all", F.struct(*requests.columns)).select(F.col(key).alias("k"), micros(at).alias("at"), F.lit(1).alias("side"), "_all", F.lit(None).cast("long").alias("born"), F.lit(None).cast(responses.schema[response].dataType).alias("answer"))
    given = responses.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("k"), micros(at).alias("at"), F.lit(0).alias("side"), micros(at).alias("born"), F.col(response).alias("answer"))
    known = F.col("k").isNotNull() & F.col("at").isNotNull()
    both = asked.where(known).unionByName(given, allowMissingColumns=True)
    last = F.when(F.col("side") == 0, F.struct("born", "answer"))
    both = latest_before(both, "k", "at", last, "last", ties=("side", "answer"), width=max(1, ttl_seconds) * SECOND).where("side = 1")
    both = both.select("_all", (F.col("at") - F.col("last.born")).alias("age_us"), F.col("last.answer").alias("answer"))
    both = both.unionByName(asked.where(~known).select("_all", F.lit(None).cast("long").alias("age_us"), "answer"))
    fresh = F.col("age_us") <= ttl_seconds * SECOND
    verdict = F.when(fresh, "hit").when(F.col("age_us").isNotNull(), "expired").otherwise("miss")
    return both.select("_all.*", F.when(fresh, F.col("answer")).alias("found"), "age_us", verdict.alias("verdict"))
