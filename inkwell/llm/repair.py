"""Structure repair of conversations: the cheapest edits that make the roles alternate.

Rows of a conversation are the columns of a lattice, what the roles so far
allow is its height, and edits are its steps. A* finds the cheapest path; the
rest of its cost is bounded from below by what every path must pay: the
deletion of each blank or repeated row, and the charge of each truncated one.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, need, small_batches

#: Costs of edits, and the charge for a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows that one search spans; a longer conversation is searched segment by segment, from all states it may be in.
SEGMENT = 4096
#: What stands between words.
_BLANK = " \t\n\x0b\f\r"

# roles so far: none, one system row, up to a user row, up to an assistant row
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_DONE = (_START, _ASSISTANT)
_NEXT = {_START: ("user", _USER), _SYSTEM: ("user", _USER), _USER: ("assistant", _ASSISTANT), _ASSISTANT: ("user", _USER)}


def keeps(state: int, initial: str) -> int | None:
    """The state after a row with this role's initial, or None where it may not stand."""
    if state == _START and initial == "s":
        return _SYSTEM
    role, after = _NEXT[state]
    return after if initial == role[0] else None


def search(rows: Sequence[tuple[str, str]], entries: Sequence[tuple[int, int]], last: bool) -> dict[int, tuple[int, int, str]]:
    """The cheapest edits of ``rows`` (role initial, fault), by state at the end: (cost, entry, audit).

    ``entries`` are (state, cost so far), in the order of their audits so far,
    which differ. Faults are "b" and "d" (blank, duplicate: must go), "t"
    (truncated) or "". Paths leave the heap by (cost plus bound, entry, audit), so
    of the cheapest the ASCII-least comes first: a path's bound never exceeds its
    cost, and no two paths of one cost to one state begin with each other. If
    ``last``, only the best of the states that may end a conversation is returned.
    """
    left = [0]
    for _, fault in reversed(rows):
        left.append(left[-1] + (DELETE if fault in ("b", "d") else TRUNCATED if fault == "t" else 0))
    left.reverse()
    heap = [(cost + left[0], n, "", 0, state) for n, (state, cost) in enumerate(entries)]
    heapq.heapify(heap)
    closed: set[tuple[int, int]] = set()
    ends: dict[int, tuple[int, int, str]] = {}
    while heap:
        bound, entry, audit, at, state = heapq.heappop(heap)
        if (at, state) in closed:
            continue
        closed.add((at, state))
        if at == len(rows):
            if not last or state in _DONE:
                ends[state] = (bound, entry, audit)
            if last and ends:
                break
            if not last:  # what is inserted here, the next segment inserts at its start
                continue
        cost = bound - left[at]
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + DELETE + left[at + 1], entry, audit + "D", at + 1, state))
            if fault not in ("b", "d"):
                stays = cost + (TRUNCATED if fault == "t" else 0) + left[at + 1]
                kept = keeps(state, initial)
                if kept is not None:
                    heapq.heappush(heap, (stays, entry, audit + "K", at + 1, kept))
                else:  # where a row may stay as it is, a new role costs more and leads to no other state
                    heapq.heappush(heap, (stays + REROLE, entry, audit + "R", at + 1, _NEXT[state][1]))
                if state == _START and initial == "s":
                    heapq.heappush(heap, (stays + REROLE, entry, audit + "R", at + 1, _USER))
        heapq.heappush(heap, (cost + INSERT + left[at], entry, audit + "I", at, _NEXT[state][1]))
    return ends


class Path:
    """The cheapest edits of a conversation whose rows come one by one."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []
        #: (audit, cost, state) of each state that the rows before may have led to, ordered
        self.so_far = [("", 0, _START)]

    def add(self, initial: str, fault: str) -> None:
        if len(self.rows) == SEGMENT:
            self._search(False)
        self.rows.append((initial, fault))

    def _search(self, last: bool) -> None:
        ends = search(self.rows, [(state, cost) for _, cost, state in self.so_far], last)
        self.so_far = sorted((self.so_far[entry][0] + audit, cost, state) for state, (cost, entry, audit) in ends.items())
        self.rows = []

    def best(self) -> tuple[int, str]:
        self._search(True)
        audit, cost, _ = self.so_far[0]
        return cost, audit


class _Conversation:
    """What is known of a conversation whose rows come by turn."""

    def __init__(self) -> None:
        self.path, self.before = Path(), None
        self.least = self.most = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, copies: int, initial: str, fault: str) -> None:
        if not copies:
            return
        if turn is not None and turn != self.turn:
            self.least, self.most, self.turn, self.turns = turn if self.least is None else self.least, turn, turn, self.turns + 1
        for _ in range(copies):
            self.blank += fault == "b"
            self.duplicate += fault == "d"
            self.truncated += fault == "t"
            self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
            self.path.add(initial, fault)
            self.before, fault = initial, fault if fault == "b" else "d"

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.path.best()


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``turns`` as ``conv, turn, role, text, copies``, damaged by crc32 of ``id:turn`` modulo 20, with the role and digest before it.

    0 drops the row (no copy), 1 empties its text, 2 takes out its stops, 3
    repeats it, 4 makes it the user's. Nulls count as one space.
    """
    clean = _clean(turns, id_col, turn_col, role_col, text_col)
    key = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = clean.withColumn("fate", F.crc32(key) % 20)
    return rows.select(
        "conv", "turn", "role0", "digest0", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _clean(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    need(turns, id_col, turn_col, role_col, text_col)
    role, text = (F.coalesce(c, F.lit(" ")) for c in (role_col, text_col))
    return turns.select(
        F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), role.alias("role0"), F.unhex(F.md5(text)).alias("digest0"), F.lit(1).cast("long").alias("copies"),
    )


def _judged(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, the role's initial and the first fault."""
    trimmed = F.rtrim(F.col("text"), F.lit(_BLANK))
    fault = F.when(F.length(trimmed) == 0, "b").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "t").otherwise("")
    key = ["conv", "turn", "role0", "digest0"]
    narrow = rows.select(*key, "role", F.unhex(F.md5("text")).alias("digest"), "copies", fault.alias("fault"))
    once = narrow.groupBy(*key).agg(F.sum("copies").alias("copies"), *[F.first(c).alias(c) for c in ("role", "digest", "fault")])
    # copies of a row are next to each other; of equal rows elsewhere the first is found by its place, so that no group of them meets
    first = once.where("copies > 0 and fault <> 'b'").groupBy("conv", "role", "digest").agg(F.min(F.struct("turn", "role0", "digest0")).alias("f"))
    first = first.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "f.*").toDF("c", "r", "d", "t", "r0", "d0").withColumn("is_first", F.lit(True))
    same = (
        F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role0") == F.col("r0")) & (F.col("digest0") == F.col("d0"))
        & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    )
    told = once.join(first, same, "left")
    fault = F.when((F.col("fault") != "b") & F.col("is_first").isNull(), "d").otherwise(F.col("fault"))
    return told.select(*key, "copies", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def repaired(rows: DataFrame, tables: Tables) -> DataFrame:
    """One row for each ``conv`` of ``rows(conv, turn, role, text, role0, digest0, copies)``: the counts, cost, audit and hash that :func:`repair` names."""
    kind = rows.schema["conv"].dataType.simpleString()

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, now, done = none, _Conversation(), []
        for batch in batches:
            for c, turn, copies, initial, fault in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    if conv is not none:
                        done.append((conv, *now.row()))
                    conv, now = c, _Conversation()
                now.add(turn, copies, initial, fault)
            yield _table(done, batch.schema.field(0).type)
            done = []
        if conv is not none:
            yield _table([(conv, *now.row())], batch.schema.field(0).type)

    judged = _judged(rows).repartition("conv").sortWithinPartitions("conv", "turn", "role0", "digest0").select("conv", "turn", "copies", "initial", "fault")
    found = judged.mapInArrow(paths, f"conv {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string")
    # each conversation's audit, then its texts in order: one hash runs over them, and a task holds a batch of texts, however long a conversation is
    audits = found.select("conv", F.lit(0).alias("kind"), F.struct(*_COUNTS, "audit").alias("found"))
    texts = rows.where("copies > 0").select("conv", F.lit(1).alias("kind"), "turn", "role0", "digest0", "copies", "role", "text")
    both = audits.unionByName(texts, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role0", "digest0")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv, found, copies, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if found is not None:
                    if now:
                        done.append(now.row())
                    now = _Repaired(conv, found)
                else:
                    now.add(copies, role, text)
            yield _table(done, batch.schema.field(0).type, "repaired_sha256")
            done = []
        if now:
            yield _table([now.row()], batch.schema.field(0).type, "repaired_sha256")

    with small_batches(rows.sparkSession):
        out = both.select("conv", "found", "copies", "role", "text").mapInArrow(hashes, f"conv {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")
        return tables.write(out)


class _Repaired:
    """The hash of a conversation's repaired rows, which come one by one after the audit."""

    def __init__(self, conv: object, found: dict) -> None:
        self.conv, self.found, self.audit = conv, found, found["audit"]
        self.sha, self.at, self.state, self.any = hashlib.sha256(), 0, _START, False

    def _emit(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            role, self.state = _NEXT[self.state]
            self._emit(role, "")
            self.at += 1

    def add(self, copies: int, role: str, text: str) -> None:
        for _ in range(copies):
            self._inserts()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit == "R":
                role, self.state = _NEXT[self.state]
            elif edit == "K":
                self.state = keeps(self.state, role[:1])
            if edit != "D":
                self._emit(role, text)

    def row(self) -> tuple:
        self._inserts()
        return self.conv, *self.found.values(), self.sha.hexdigest()


def _table(rows: list[tuple], kind: pa.DataType, *more: str) -> pa.RecordBatch:
    names = ["conv", *_COUNTS, "audit", *more]
    types = [kind, *[pa.int64() for _ in _COUNTS], pa.string(), *[pa.string() for _ in more]]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def repair(
    turns: DataFrame, damage: bool = False, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tables: Tables | None = None
) -> DataFrame:
    """One row for each id of ``turns``: its faults and the cheapest edits that repair it.

    Edits, row by row in the order of turns: Keep (0), Rerole to user or
    assistant (3), Delete (4), Insert an empty user or assistant row anywhere
    (3). Blank and duplicate rows (role and text seen before) must be deleted; a
    row whose last visible sign is no stop adds 3 unless deleted. The roles'
    initials must become ``(s?(ua)+)?``. ``audit`` has the edits' initials, of
    equal cost the ASCII-least; ``repaired_sha256`` is the hash of the
    repaired ``role:text`` rows, joined by newlines. ``gaps``, ``blank``,
    ``duplicate``, ``truncated`` and ``illegal`` count turns that are missing
    between the first and the last, rows by their first fault, and neighbours
    whose initials are none of su, ua, au. With ``damage``, rows are damaged first
    (:func:`damaged`); an id whose rows are all dropped has zeros.

    Null roles and texts are one space, null turns come first, ties in turn are
    ordered by role and digest of the text; repeated rows are duplicates; a null
    id is one conversation; no rows give none. Other columns are not read.
    """
    tables = tables or Tables(turns.sparkSession)
    rows = (damaged if damage else _clean)(turns, id_col, turn_col, role_col, text_col)
    return repaired(rows, tables).withColumnRenamed("conv", id_col)
