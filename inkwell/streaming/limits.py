"""Requests a host may make: trailing windows, admission, waiting for a slot; as tables and as streams.

The limiter is a fold over a host's operations in order of time. As a table, a
host's timeline is cut where nothing of the past is left (:mod:`..operators.scans`),
and each piece is read once, in order, by one task that keeps only what the
window holds. As a stream, the same fold's state lies in the state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.scans import SECOND, micros, trailing, with_segment

#: The trailing window, the longest wait for a slot and the longest backoff, in seconds.
WINDOW, MAX_WAIT, MAX_BACKOFF = 60, 30, 300
#: Fixed value: errors in the window beyond which the backoff no longer doubles.
MOST_DOUBLINGS = 6


def trailing_counts(requests: DataFrame, host: str = "host", at: str = "ts", seconds: int = WINDOW) -> DataFrame:
    """``requests`` with ``recent``: how many the host made in the seconds up to this one, itself included."""
    return trailing(requests.withColumn("_us", micros(at)), host, "_us", seconds * SECOND, "recent").drop("_us")


class Limiter:
    """Requests of one host: those in the trailing window, those that wait, and a backoff. Times are microseconds.

    Equal starts are one entry with a count, so what is kept is bounded by the
    limit and by the different ends of waits, not by the number of requests.
    """

    def __init__(self, most: int, window: int = WINDOW * SECOND, max_wait: int = MAX_WAIT * SECOND, recent=(), waiting=(), blocked_until: int = 0) -> None:
        self.most, self.window, self.max_wait = most, window, max_wait
        self.recent, self.waiting, self.blocked_until = [list(r) for r in recent], [list(r) for r in waiting], blocked_until
        self.count = sum(n for _, n in self.recent)

    def state(self) -> tuple[list, list, int]:
        return self.recent, self.waiting, self.blocked_until

    def settle(self, now: int) -> None:
        """Waits that are over by ``now`` have become requests; requests that left the window are forgotten."""
        over = [w for w in self.waiting if w[0] <= now]
        if over:
            self.waiting = [w for w in self.waiting if w[0] > now]
            self.recent = sorted(self.recent + over)
            self.count += sum(n for _, n in over)
        gone = 0
        while gone < len(self.recent) and self.recent[gone][0] <= now - self.window:
            self.count -= self.recent[gone][1]
            gone += 1
        del self.recent[:gone]

    def wait(self, now: int) -> int:
        """Until the next request may be made: the end of the backoff, or when the oldest request leaves the window."""
        if now < self.blocked_until:
            return self.blocked_until - now
        return 0 if self.count < self.most or not self.recent else self.recent[0][0] + self.window - now

    def request(self, now: int) -> tuple[bool, int]:
        """Whether a request at ``now`` will be made, and its wait. One that would wait too long is refused and takes nothing."""
        self.settle(now)
        wait = self.wait(now)
        if wait > self.max_wait:
            return False, wait
        into, start = (self.waiting, now + wait) if wait else (self.recent, now)
        if into and into[-1][0] == start:
            into[-1][1] += 1
        else:
            into.append([start, 1])
            into.sort()
        self.count += 0 if wait else 1
        return True, wait

    def error(self, now: int, retry_after: float | None = None) -> None:
        """The host asked for a pause, or failed: then the pause doubles with the requests in the window."""
        self.settle(now)
        pause = min(MAX_BACKOFF, 2 ** min(self.count, MOST_DOUBLINGS)) if retry_after is None else retry_after
        self.blocked_until = now + int(pause * SECOND)

    def reset(self) -> None:
        """Forgets the host; what waits already will still be made."""
        self.recent, self.count, self.blocked_until = [], 0, 0

    def view(self, now: int) -> tuple[int, int, int]:
        """(requests in the window, rest of the backoff, wait)."""
        self.settle(now)
        return self.count, max(0, self.blocked_until - now), self.wait(now)


def apply_limit(limiter: Limiter, op: str, now: int, retry_after: float | None) -> tuple:
    """(admitted, wait_us, in_window, backoff_us) of one operation; the last two are as it finds them."""
    in_window, backoff, _ = limiter.view(now)
    admitted = wait = None
    if op == "request":
        admitted, wait = limiter.request(now)
    elif op == "error":
        limiter.error(now, retry_after)
    elif op == "reset":
        limiter.reset()
    return admitted, wait, in_window, backoff


_VIEW = "admitted boolean, wait_us long, in_window long, backoff_us long"


def limit_log(
    ops: DataFrame, most: int, host: str = "host", at: str = "ts", op: str | None = None, retry_after: str | None = None, id_col: str = "event_id",
    seconds: int = WINDOW, max_wait: float = MAX_WAIT,
) -> DataFrame:
    """Each operation of ``ops`` (``host``, ``id_col``, ``at`` and below) with what the limiter says to it.

    ``op`` names the column of operations: ``request`` (all, without a column),
    ``error`` (with ``retry_after`` seconds, if that column is given and not
    null), ``reset``; others only look. Of a request, ``admitted`` and
    ``wait_us`` tell whether it is made and after how long; one that would wait
    longer than ``max_wait`` is refused and not recorded. ``in_window`` and
    ``backoff_us`` are the state that the operation meets. Order: time, then id;
    a null time is left out, a null host is a host of its own.
    """
    window, longest = seconds * SECOND, int(max_wait * SECOND)
    kind, named = ops.schema[id_col].dataType.simpleString(), ops.schema[host].dataType.simpleString()
    rows = ops.where(F.col(at).isNotNull()).select(
        F.struct(F.col(host)).alias("h"), F.col(id_col).alias("id"), micros(at).alias("at"), (F.lit("request") if op is None else F.col(op)).alias("op"),
        (F.lit(None) if retry_after is None else F.col(retry_after)).cast("double").alias("pause"),
    )
    pause = F.when(F.col("op") == "error", F.coalesce(F.ceil(F.col("pause") * SECOND), F.lit(MAX_BACKOFF * SECOND))).otherwise(0)
    rows = rows.withColumn("until", F.col("at") + F.greatest(F.lit(window + longest), pause))
    rows = with_segment(rows.withColumn("k", F.to_json("h", {"ignoreNullFields": "false"})), "k", "at", "until", max(window, SECOND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, limiter = None, None
        for batch in batches:
            k, segment, now, what, rest = (c.to_pylist() for c in batch.columns[:5])
            out = []
            for i in range(len(k)):
                if (k[i], segment[i]) != piece:
                    piece, limiter = (k[i], segment[i]), Limiter(most, window, longest)
                out.append(apply_limit(limiter, what[i], now[i], rest[i]))
            found = [pa.array([o[j] for o in out], t) for j, t in enumerate((pa.bool_(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[5:], batch.column(2), *found], [*batch.schema.names[5:], "at", "admitted", "wait_us", "in_window", "backoff_us"])

    ordered = rows.repartition("k", "segment").sortWithinPartitions("k", "segment", "at", "id")
    ordered = ordered.select("k", "segment", "at", "op", "pause", F.col(f"h.{host}").alias(host), F.col("id").alias(id_col))
    return ordered.mapInArrow(run, f"`{host}` {named}, `{id_col}` {kind}, at long, {_VIEW}")


def admission(requests: DataFrame, most: int, host: str = "host", at: str = "ts", seconds: int = WINDOW) -> DataFrame:
    """(host, n, admitted): requests of each host and how many of them are made at once; a refused one takes nothing from later ones."""
    log = limit_log(requests.withColumn("_id", F.lit(0)), most, host, at, id_col="_id", seconds=seconds, max_wait=0)
    return log.groupBy(host).agg(F.count("*").alias("n"), F.count_if("admitted").alias("admitted"))


def admit(times: list[float], most: int, seconds: int = WINDOW, before: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Which requests are admitted, and the admitted ones that still count.

    A refused request isn't recorded, so it takes nothing from later ones.
    """
    recent, out = list(before or []), []
    for t in times:
        recent = [x for x in recent if x > t - seconds]
        out.append(len(recent) < most)
        if out[-1]:
            recent.append(t)
    return out, recent


def admission_stream(requests: DataFrame, most: int, host: str = "host", at: str = "ts", seconds: int = WINDOW) -> DataFrame:
    """The same as a stream: (host, ts, admitted) for every request, with the recent admissions as the host's state.

    Late requests are judged when they come; state ends an idle window after
    the last request.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        for frame in frames:
            frame = frame.sort_values("ts")
            ok, recent = admit([t.timestamp() for t in frame["ts"]], most, seconds, recent)
            yield pd.DataFrame({"host": key[0], "ts": frame["ts"], "admitted": ok})
        state.update((recent,))
        state.setTimeoutDuration(2 * seconds * 1000)

    rows = requests.select(F.col(host).cast("string").alias("host"), F.col(at).cast("timestamp").alias("ts"))
    return rows.groupBy("host").applyInPandasWithState(run, "host string, ts timestamp, admitted boolean", "recent array<double>", "append", "ProcessingTimeTimeout")


class SlotProcessor(StatefulProcessor):
    """The limiter of each host in the state store: requests that wait are held there until their timer.

    A request comes out once: at once if it may be made or is refused, else when
    event time has passed its start. Operations of a batch are taken in order of
    time; one that comes late is judged at the time the host has reached.
    """

    def __init__(self, most: int, window: int, max_wait: int) -> None:
        self.most, self.window, self.max_wait = most, window, max_wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.limiter = handle.getValueState("limiter", "recent array<array<long>>, waiting array<array<long>>, blocked_until long, now long")
        self.held = handle.getMapState("held", "start long, id string", "wait long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.limiter.get()
        limiter, reached = (Limiter(self.most, self.window, self.max_wait, *kept[:3]), kept[3]) if kept else (Limiter(self.most, self.window, self.max_wait), 0)
        for at, id_, op, pause in sorted(((r.at, r.id, r.op, r.pause) for r in rows), key=lambda r: (r[0], str(r[1]))):
            reached = max(reached, at)
            admitted, wait, *_ = apply_limit(limiter, op, reached, pause)
            if admitted and wait:
                self.held.updateValue((reached + wait, id_), (wait,))
                self.handle.registerTimer(-(-(reached + wait) // 1000))
            elif op == "request":
                yield Row(host=key[0], id=id_, admitted=admitted, wait_us=wait, start_us=reached if admitted else None)
        self.limiter.update((*limiter.state(), reached))
        # when nothing of the host is left, its state goes
        self.handle.registerTimer(-(-max(reached + self.window + self.max_wait, limiter.blocked_until) // 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted((start, id_, wait) for (start, id_), (wait,) in self.held.iterator() if start <= now)
        for start, id_, wait in due:
            self.held.removeKey((start, id_))
            yield Row(host=key[0], id=id_, admitted=True, wait_us=wait, start_us=start)
        kept = self.limiter.get()
        if kept and now > max(kept[3] + self.window + self.max_wait, kept[2]):
            self.limiter.clear()

    def close(self) -> None:
        pass


def slot_stream(
    ops: DataFrame, most: int, host: str = "host", at: str = "ts", op: str | None = None, retry_after: str | None = None, id_col: str = "event_id",
    seconds: int = WINDOW, max_wait: float = MAX_WAIT, late: str = "1 minute",
) -> DataFrame:
    """The requests of a stream of operations as they are made or refused: (host, id, admitted, wait_us, start_us).

    As :func:`limit_log`, but a request that waits appears when event time, which
    trails by ``late``, has passed its start. Needs the RocksDB state store
    (:data:`ROCKSDB`).
    """
    rows = ops.select(
        F.col(host).cast("string").alias("host"), F.col(id_col).cast("string").alias("id"), F.col(at).cast("timestamp").alias("ts"), micros(at).alias("at"),
        (F.lit("request") if op is None else F.col(op)).alias("op"), (F.lit(None) if retry_after is None else F.col(retry_after)).cast("double").alias("pause"),
    ).withWatermark("ts", late)
    schema = "host string, id string, admitted boolean, wait_us long, start_us long"
    return rows.groupBy("host").transformWithState(SlotProcessor(most, seconds * SECOND, int(max_wait * SECOND)), schema, "append", "eventTime")


#: The state store that streams of this package with timers or maps need, as a setting of the session.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
