"""Caches, limits and running results over time: folds against plain definitions, tables against streams."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from inkwell.operators import scans
from inkwell.streaming import caches, limits

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
S = 1_000_000


def at(seconds):
    return T0 + timedelta(seconds=seconds)


# --- scans -------------------------------------------------------------------


def test_segments_begin_with_nothing_left(spark):
    rows = [("a", 0, 5), ("a", 4, 6), ("a", 7, 8), ("a", 100, 260), ("a", 230, 231), ("a", 262, 263), ("b", 3, 3), (None, 1, 2)]
    got = scans.with_segment(spark.createDataFrame(rows, "k string, at long, until long"), "k", "at", "until", 10).where("k = 'a'").orderBy("at").collect()
    segments = [r.segment for r in got]
    assert len(got) == 6 and segments[0] == segments[2] != segments[3] == segments[4]
    for x, y in zip(got, got[1:]):
        assert x.segment == y.segment or max(r.until for r in got if r.at <= x.at) < y.at


def test_after_delays_is_the_recurrence(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(0, 400), rng.randrange(0, 30), i) for i in range(300)]
    want, last = {}, {}
    for k, t, d, i in sorted(rows, key=lambda r: (r[1], r[3])):
        last[k] = max(t, last[k] + d) if k in last else t
        want[i] = last[k]
    df = spark.createDataFrame(rows, "k string, at long, delay long, i long")
    for width in (1, 37, 10_000):
        assert {r.i: r.start for r in scans.after_delays(df, "k", "at", "delay", ("i",), width).collect()} == want


def test_latest_before_and_trailing(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(0, 300), rng.choice([None, None, i]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, at long, v long, i long")
    for width in (7, 1000):
        got = {r.i: (r.last, r.n) for r in scans.trailing(scans.latest_before(df, "k", "at", "v", "last", ("i",), width), "k", "at", 20, "n").collect()}
        for k, t, _, i in rows:
            seen = sorted((b, j, v) for a, b, v, j in rows if a == k and (b, j) <= (t, i) and v is not None)
            assert got[i] == (seen[-1][2] if seen else None, sum(a == k and t - 20 <= b <= t for a, b, _, _ in rows))


# --- limits ------------------------------------------------------------------


def plain_limit(ops, most, window, max_wait):
    """The rules told one by one, with every start kept."""
    starts, blocked, out = [], 0, []
    for now, op, pause in ops:
        inside = [s for s in starts if now - window < s <= now]
        row = [None, None, len(inside), max(0, blocked - now)]
        if op == "request":
            wait = blocked - now if now < blocked else 0 if len(inside) < most else min(inside) + window - now
            row[:2] = wait <= max_wait, wait
            if wait <= max_wait:
                starts.append(now + wait)
        elif op == "error":
            blocked = now + (min(300, 2 ** min(len(inside), 6)) * S if pause is None else int(pause * S))
        elif op == "reset":
            starts, blocked = [s for s in starts if s > now], 0
        out.append(tuple(row))
    return out


@pytest.fixture(scope="module")
def traffic():
    rng, now, ops = random.Random(3), 0, []
    for i in range(900):
        now += rng.choice([0, 0, S // 2, S, 3 * S, 20 * S, 40 * S, 900 * S if i % 50 == 0 else S])
        ops.append((now, rng.choices(["request", "error", "reset", "other"], [30, 1, 1, 1])[0], rng.choice([None, 2.5, 45.0])))
    return ops


def test_limiter_by_definition(traffic):
    limiter = limits.Limiter(4)
    got = [limits.apply_limit(limiter, op, now, pause) for now, op, pause in traffic]
    assert got == plain_limit(traffic, 4, 60 * S, 30 * S)
    assert {g[0] for g in got} == {True, False, None} and any(g[0] and g[1] for g in got)
    burst = limits.Limiter(1)
    assert sum(burst.request(t)[0] for t in [0, *range(31 * S, 60 * S, 1000)]) > 20_000 and len(burst.recent) + len(burst.waiting) == 2


def test_limit_log_of_several_hosts(spark, traffic):
    rows = [(h, 2 * i + j, at(now / S), op, pause) for i, (now, op, pause) in enumerate(traffic) for j, h in enumerate(("a", None))] + [("b", -1, None, "request", None)]
    ops = spark.createDataFrame(rows, "host string, event_id long, ts timestamp, op string, pause double").repartition(7)
    log = limits.limit_log(ops, 4, op="op", retry_after="pause").orderBy("event_id").collect()
    want = plain_limit(traffic, 4, 60 * S, 30 * S)
    for j, host in enumerate(("a", None)):
        assert [(r.admitted, r.wait_us, r.in_window, r.backoff_us) for r in log if r.event_id % 2 == j] == want
        assert {r.host for r in log if r.event_id % 2 == j} == {host}
    assert limits.limit_log(ops.where("false"), 4).count() == 0
    few = limits.admission(ops.where("op = 'request' and host = 'a'"), 4).first()
    ok, _ = limits.admit([now / S for now, op, _ in traffic if op == "request"], 4)
    assert (few.n, few.admitted) == (len(ok), sum(ok))


@pytest.fixture
def rocksdb(spark):
    before = {k: spark.conf.get(k, None) for k in limits.ROCKSDB}
    for k, v in limits.ROCKSDB.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def run_stream(spark, tmp_path, batches, schema, build, name):
    """Each batch a file and a micro-batch; what came out in the end."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"b{i}"))
        next((tmp_path / f"b{i}").glob("*.parquet")).rename(folder / f"{i:03}.parquet")
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name).collect()


def test_slots_as_a_stream(spark, tmp_path, rocksdb):
    schema = "host string, event_id long, ts timestamp"
    times = [0, 1, 2, 35, 36, 70, 71, 72, 90]
    rows = [("a", i, at(t)) for i, t in enumerate(times)]
    later = [[("z", 100, at(400))], [("z", 101, at(800))]]
    got = run_stream(spark, tmp_path, [rows[:4], rows[4:], *later], schema, lambda d: limits.slot_stream(d, 2), "slots")
    log = limits.limit_log(spark.createDataFrame(rows, schema), 2).collect()
    assert {(r.event_id, r.admitted, r.wait_us) for r in log} == {(int(r.id), r.admitted, r.wait_us) for r in got if r.host == "a"}
    held = [r for r in got if r.host == "a" and r.wait_us and r.admitted]
    assert held and all(r.start_us == int((T0.timestamp() + times[int(r.id)]) * S) + r.wait_us for r in held)


# --- caches ------------------------------------------------------------------


def plain_cache(ops, capacity, ttl):
    entries, out = {}, []
    for now, op, key, value, life in ops:
        entries = {k: e for k, e in entries.items() if e[1] >= now}
        old, victim = entries.get(key), None
        writes = op == "set" or (op == "fetch" and old is None)
        if writes:
            if len(entries) >= capacity:
                victim = min(entries, key=lambda k: entries[k][1])  # of ties the one first written
                del entries[victim]
            entries[key] = (value, now + (ttl if life is None else life))
        elif op == "delete":
            entries.pop(key, None)
        elif op == "clear":
            entries = {}
        out.append((
            old is not None if op in ("get", "set", "fetch", "delete") else None, old[0] if op in ("get", "fetch") and old else None, victim if writes else None, old is None if writes else None, len(entries),
        ))
    return out


@pytest.fixture(scope="module")
def visits():
    rng, now, ops = random.Random(4), 0, []
    for i in range(1500):
        now += rng.choice([0, 0, S, 5 * S, 400 * S if i % 100 == 0 else S])
        ops.append((now, rng.choices(caches.OPERATIONS, [4, 6, 8, 1, 0.1, 1])[0], f"k{rng.randrange(9)}", f"v{i}", rng.choice([None, None, 3 * S])))
    return ops


def test_cache_by_definition(visits):
    cache = caches.Cache(4, 20 * S)
    got = [caches.apply_op(cache, op, key, value, now, life) for now, op, key, value, life in visits]
    assert got == plain_cache(visits, 4, 20 * S) and any(g[2] for g in got)
    again = caches.Cache(4, 20 * S, cache.entries)
    assert again.entries == cache.entries and len(cache.index) <= 2 * len(cache.entries) + 65
    full = caches.Cache(2, 10)
    assert (full.set("a", "1", 0), full.set("b", "2", 1), full.set("a", "3", 2), full.set("c", "4", 3)) == (None, None, "a", "b")
    assert full.get("a", 12) == "3" and full.get("a", 13) is None and full.delete("c") and not full.delete("c")


def test_cache_log_and_stream_agree(spark, tmp_path, visits, rocksdb):
    schema = "event_id long, cache string, key string, ts timestamp, op string, value string, life double"
    rows = [(2 * i + j, c, k, at(now / S), op, v, life and life / S) for i, (now, op, k, v, life) in enumerate(visits) for j, c in enumerate(("x", None))]
    ops = spark.createDataFrame(rows, schema)
    want = plain_cache(visits, 4, 20 * S)
    log = caches.cache_log(ops.repartition(5), 4, 20, ttl="life").orderBy("event_id").collect()
    for j in (0, 1):
        assert [(r.hit, r.found, r.evicted, r.is_new, r.size) for r in log if r.event_id % 2 == j] == want
    some = [r for r in rows if r[1] == "x"][:400]
    got = run_stream(spark, tmp_path, [some[:150], some[150:300], some[300:]], schema, lambda d: caches.cache_op_stream(d, 4, 20, ttl="life"), "cache_ops")
    got = sorted(got, key=lambda r: r.id)
    assert [(r.hit, r.found, r.evicted, r.is_new, r.size) for r in got] == want[:400]


def test_lookups_as_of(spark):
    asked = spark.createDataFrame([(1, "a", at(10), "x"), (2, "a", at(70), "x"), (3, "a", at(71), "x"), (4, "b", at(5), "x"), (5, None, at(5), "x"), (6, "a", None, "x"), (1, "a", at(10), "x")], "i long, key string, ts timestamp, last string")
    given = spark.createDataFrame([("a", at(10), 7), ("a", at(9), 6), ("a", at(500), 8), (None, at(1), 9), ("b", None, 1)], "key string, ts timestamp, response_id long")
    got = sorted((r.i, r.found, r.age_us, r.verdict, r.last) for r in caches.lookups(asked, given, 60).collect())
    assert [g[:4] for g in got] == [(1, 7, 0, "hit"), (1, 7, 0, "hit"), (2, 7, 60 * S, "hit"), (3, None, 61 * S, "expired"), (4, None, None, "miss"), (5, None, None, "miss"), (6, None, None, "miss")]
    assert {g[4] for g in got} == {"x"} and caches.lookups(asked.where("false"), given, 60).count() == 0
    assert caches.lookups(asked, given.where("false"), 60).where(F.col("verdict") == "miss").count() == 7
