"""Scoped retrieval, paging, completion, listing."""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sentences import question_terms, term_matches

#: Rows of a page and of a completion.
PAGE, COMPLETIONS = 50, 100
_COMPARE = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b,
}


class FilterError(ValueError):
    """A filter that can't be read."""


def folder_range(prefix: str) -> dict:
    """A folder's contents as a range, which scans can prune by: beyond the prefix, up to it and a z."""
    return {"type": "and", "filters": [{"type": "gt", "key": "folder", "value": prefix}, {"type": "lte", "key": "folder", "value": prefix + "z"}]}


def with_scope(filters: dict | None, scope: dict | None) -> dict | None:
    """A filter that holds within a scope, too."""
    if not scope:
        return filters or None
    extra = scope["filters"] if scope.get("type") == "and" else [scope]
    if not filters:
        return {"type": "and", "filters": list(extra)}
    if filters.get("type") == "and" and isinstance(filters.get("filters"), list):
        return {"type": "and", "filters": [*filters["filters"], *extra]}
    if filters.get("type") == "or" or filters.get("type") in _COMPARE:
        return {"type": "and", "filters": [filters, *extra]}
    raise FilterError("filters have an unsupported shape")


def predicate(filters: dict | None) -> Column:
    """A filter tree as a predicate that the optimizer can push down."""
    if not filters:
        return F.lit(True)
    kind = filters.get("type")
    if kind in ("and", "or"):
        parts = [predicate(f) for f in filters.get("filters", [])]
        return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), parts, F.lit(kind == "and"))
    if kind in _COMPARE:
        return _COMPARE[kind](F.col(filters["key"]), F.lit(filters["value"]))
    raise FilterError(f"unknown filter type {kind!r}")


def search(chunks: DataFrame, query: str, filters: dict | None = None, scope: dict | None = None, most: int = 10, threshold: float = 0.0, text_col: str = "text", id_col: str = "chunk_id") -> DataFrame:
    """The best chunks for a query: ``score`` is the share of its terms that they hold; ties by id.

    The limit is taken a partition first, so only ``most`` rows a task move.
    """
    terms = question_terms(query)
    score = term_matches(F.col(text_col), terms) / max(1, len(terms))
    rows = chunks.where(predicate(with_scope(filters, scope))).withColumn("score", score)
    return rows.where((F.col("score") > 0) & (F.col("score") >= threshold)).orderBy(F.col("score").desc(), id_col).limit(most)


def encode_cursor(offset: int) -> str:
    return base64.b64encode(json.dumps({"offset": offset}, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str) -> int:
    """The offset of a cursor; ValueError if it is malformed."""
    try:
        offset = json.loads(base64.b64decode(cursor, validate=True))["offset"]
    except Exception as e:
        raise ValueError("Invalid cursor") from e
    if not isinstance(offset, int) or isinstance(offset, bool) or offset < 0:
        raise ValueError("Invalid cursor")
    return offset


def page(rows: DataFrame, order: list[Column | str], cursor: str | None = None, size: int = PAGE) -> tuple[DataFrame, str | None]:
    """One page and the next page's cursor, if there is more. An offset beyond the rows is an error, at their end a page of none."""
    offset = decode_cursor(cursor) if cursor else 0
    seen = rows.orderBy(*order).offset(offset).limit(size + 1)
    n = seen.count()
    if not n and offset > rows.count():
        raise ValueError("Invalid cursor")
    return seen.limit(size), encode_cursor(offset + size) if n > size else None


def complete(values: DataFrame, typed: str, column: str = "value", most: int = COMPLETIONS) -> DataFrame:
    """Distinct values that hold what was typed, earliest first, then shorter, then in order."""
    low = F.lower(F.col(column))
    at = F.instr(low, typed.lower()) if typed else F.lit(1)
    return values.select(F.col(column)).where(F.length(F.trim(column)) > 0).distinct().withColumn("at", at).where("at > 0").orderBy("at", F.length(column), column).limit(most).drop("at")


def listing(packets: DataFrame) -> DataFrame:
    """Packets, newest first; a time that can't be read is the oldest; ties by id."""
    when = F.coalesce(F.try_to_timestamp("retrieved_at"), F.timestamp_seconds(F.lit(0)))
    return packets.orderBy(when.desc(), "source_id")


def newest(entries: DataFrame, now: Column, ttl_seconds: int, most: int | None = None, key: str = "key", at: str = "ts") -> DataFrame:
    """A cache's content: the last entry a key that isn't too old, and of these the ``most`` that expire last."""
    live = entries.where((F.col(at) > now - F.make_dt_interval(secs=F.lit(float(ttl_seconds)))) & (F.col(at) <= now))
    # a maximum combines before the shuffle, however often a key was written
    live = live.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*entries.columns), F.col(at)).alias("_last")).select("_last.*")
    return live if most is None else live.orderBy(F.col(at).desc(), key).limit(most)


def scope_ids(rows: DataFrame, root: Column, thread: Column | None = None) -> DataFrame:
    """``rows`` with ``workspace_id`` and, for threads, ``thread_id``: short hashes."""
    out = rows.withColumn("workspace_id", F.substring(F.sha2(root, 256), 1, 12))
    return out if thread is None else out.withColumn("thread_id", F.substring(F.sha2(thread, 256), 1, 16))


def workspace_root(start: str, override: str = "") -> str:
    """The folder that a workspace is known by: the one given, else the nearest above ``start`` with a ``.git``, else ``start``."""
    if override.strip():
        return str(Path(override.strip()).resolve())
    here = Path(start).resolve()
    return str(next((p for p in (here, *here.parents) if (p / ".git").exists()), here))


def scope_of(kind: Column, workspace: Column, thread: Column, conversation: Column, base: Column, require_thread: bool = False) -> Column:
    """(scope, workspace_id, conversation_id, upload_prefix, folder_prefix, error) of what is asked for: global, workspace or conversation.

    A conversation without a thread falls back to its workspace or, with
    ``require_thread``, is an error. Other kinds are taken for a conversation.
    """
    none = F.lit(None).cast("string")
    named = F.length(F.trim(F.coalesce(thread, F.lit("")))) > 0
    within = F.concat(base, F.lit("workspaces/"), workspace, F.lit("/"))
    talk = F.concat(within, F.lit("conversations/"), conversation, F.lit("/"))

    def scope(name: Column, ws: Column, conv: Column, upload: Column, folder: Column, error: Column = none) -> Column:
        return F.struct(name.alias("scope"), ws.alias("workspace_id"), conv.alias("conversation_id"), upload.alias("upload_prefix"), folder.alias("folder_prefix"), error.alias("error"))

    whole = scope(F.lit("workspace"), workspace, none, within, within)
    missing = scope(none, none, none, none, none, F.lit("AI_SEARCH_MISSING_THREAD_KEY")) if require_thread else whole
    return (
        F.when(kind == "global", scope(F.lit("global"), none, none, base, F.lit(""))).when(kind == "workspace", whole).when(~named, missing)
        .otherwise(scope(F.lit("conversation"), workspace, conversation, talk, talk))
    )


def request_json(query: Column, set_: Mapping[str, Column] | None = None, given: Mapping[str, Column] | None = None) -> Column:
    """A search request: ``set_`` options are in it unless null, ``given`` ones unless null, empty, zero or false."""
    fields = [query.alias("query"), *[c.alias(n) for n, c in (set_ or {}).items()]]
    for name, c in (given or {}).items():
        text = c.cast("string")
        fields.append(F.when(~text.isin("", "0", "false"), c).alias(name))
    return F.to_json(F.struct(*fields))


def wait_ms(asked: Column, most: int) -> Column:
    """How long to wait before a query: what is asked for, at least nothing and ``most`` at most."""
    return F.least(F.greatest(F.coalesce(asked, F.lit(0)).cast("long"), F.lit(0)), F.lit(most).cast("long"))


def upsert_threads(threads: DataFrame, seen: DataFrame) -> DataFrame:
    """Known threads and those seen now: an id is kept or made from the key, times are widened."""
    now = seen.groupBy("key").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    both = threads.join(now, "key", "full")
    return both.select(
        "key", F.coalesce("conversation_id", F.substring(F.sha2("key", 256), 1, 16)).alias("conversation_id"),
        F.coalesce("created_at", "first").alias("created_at"), F.greatest("last_used_at", "last").alias("last_used_at"),
    )


def missing_objects(parts: DataFrame, existing: DataFrame, key: str = "key") -> DataFrame:
    """Parts whose key isn't stored yet."""
    return parts.join(existing.select(key), key, "left_anti")
