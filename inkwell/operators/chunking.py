"""Documents cut into chunks of a token budget."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kinds as K
from ..functions.regex import Rx, trim_text, units_of
from ..functions.rowwise import with_made
from ..functions.tokens import SENTENCE_END, tokens_of
from .markdown import Path, atx, walk
from .markdown import blocks as blocks_of

_ITEM = Rx(r"^\s*(?:[-*+]|[0-9]+[.)])\s+").py
_RULE = Rx(r"^\s*\|?[\s:-]+\|").py
_FENCE = Rx(r"^\s*(```+|~~~+)").py
_HEAD = Rx(r"^(#{1,6})\s+(.+)$").py
#: Characters that a token is taken for when a text is cut, and how late a break must stand.
CUT_CHARS, LATE_PARAGRAPH, LATE_LINE = 3.5, 0.7, 0.8
#: Two chunks are merged below these shares of the budget, of both together and of the first.
MERGED, SMALL = 0.8, 0.3
STRATEGIES = ("headings_first", "balanced")


def budget_of(max_tokens: int, margin_ratio: float) -> int:
    """The tokens that a chunk may have; below 1 nothing could ever be cut, which is an error."""
    if (budget := math.floor(max_tokens * (1 - margin_ratio))) < 1:
        raise ValueError(f"max_tokens={max_tokens} with margin_ratio={margin_ratio} leaves no token")
    return budget


def cut_text(text: str, budget: int) -> list[str]:
    """Pieces of about the budget, cut at a paragraph, sentence or line end if one stands late enough."""
    pieces = []
    while text:
        # a token is taken for so many characters at most, so a longer text needn't be counted
        if len(text) <= budget * CUT_CHARS and tokens_of(text) <= budget:
            pieces.append(trim_text(text))
            break
        at = min(math.floor(budget * CUT_CHARS), len(text))
        paragraph, line = text.rfind("\n\n", 0, at + 2), text.rfind("\n", 0, at + 1)
        end = SENTENCE_END.py.search(text[:at])
        if paragraph > at * LATE_PARAGRAPH:
            at = paragraph
        elif end and end.start() > at * LATE_PARAGRAPH:
            at = end.start() + 1
        elif line > at * LATE_LINE:
            at = line
        pieces.append(trim_text(text[:at]))
        text = trim_text(text[at:])
    return [p for p in pieces if p]


def packed(parts: list[str], budget: int, start: int, wrap: Callable[[list[str]], str], over: Callable[[str, int], list[str] | None]) -> list[str] | None:
    """Parts put together in order while they fit; ``start`` tokens are used from the outset.

    ``over`` cuts a part that doesn't fit by itself, given what is used; if it
    returns None, so does this.
    """
    out, held, used = [], [], start
    for part in parts:
        t = tokens_of(part)
        if held and used + t > budget:
            out.append(wrap(held))
            held, used = [], start
        pieces = over(part, used)
        if pieces is None:
            return None
        if pieces:
            out += pieces
            continue
        held.append(part)
        used += t
    return out + ([wrap(held)] if held else [])


def cut_list(text: str, budget: int) -> list[str]:
    """Whole items, packed; what stands before the first one is dropped."""
    items: list[list[str]] = []
    for line in text.split("\n"):
        if _ITEM.match(line):
            items.append([line])
        elif items:
            items[-1].append(line)
    if not items:
        return cut_text(text, budget)
    return packed(["\n".join(i) for i in items], budget, 0, "\n".join, lambda p, _: cut_text(p, budget) if tokens_of(p) > budget else []) or []


def cut_table(text: str, budget: int) -> list[str]:
    """Rows, packed below a repeated header; a table with a row too long is cut as text."""
    rows = [x for x in text.split("\n") if trim_text(x)]
    if len(rows) <= 2:
        return [trim_text(text)]
    top = "\n".join(rows[:2])
    room = budget - tokens_of(top)
    if not _RULE.match(rows[1]) or room <= 0:
        return cut_text(text, budget)
    done = packed(rows[2:], budget, budget - room, lambda held: "\n".join([top, *held]), lambda p, _: None if tokens_of(p) > room else [])
    return cut_text(text, budget) if done is None else done


def cut_code(text: str, budget: int) -> list[str]:
    """Lines, packed inside the block's own fence; longer lines are cut by themselves."""
    if tokens_of(text) <= budget:
        return [trim_text(text)]
    rows = text.split("\n")
    if not (m := _FENCE.match(rows[0])):
        return cut_text(text, budget)
    marks, top = m[1], trim_text(rows[0])
    closing = [i for i in range(1, len(rows)) if (c := _FENCE.match(rows[i])) and c[1][0] == marks[0] and len(c[1]) >= len(marks)]
    body = rows[1 : closing[-1]] if closing else rows[1:]

    def wrap(held: list[str]) -> str:
        return "\n".join([top, *held, marks])

    def over(line: str, used: int) -> list[str]:
        return [wrap([p]) for p in cut_text(line, max(10, budget - used))] if tokens_of(line) > budget - used else []

    return packed(body, budget, tokens_of(f"{top}\n{marks}"), wrap, over) or []


CUTTERS = {"code": cut_code, "list": cut_list, "table": cut_table}


def pack_blocks(blocks: list[dict], budget: int, strategy: str) -> Iterator[tuple[str, str]]:
    """(path, text) of chunks made of whole blocks; only a block over the budget is cut."""
    path, held, used, begun = Path(), [], 0, ""
    for block in blocks:
        text, kind = trim_text(block["text"]), block["kind"]
        if not text:
            continue
        head = _HEAD.match(block["text"].split("\n")[0]) if kind == "heading" else None
        if head:
            path.enter(len(head[1]), trim_text(head[2]))
        t = tokens_of(text)
        starts = strategy == "headings_first" and head is not None and len(head[1]) <= 3
        if held and (starts or t > budget or used + t > budget):
            yield begun, "\n\n".join(held)
            held, used = [], 0
        if t > budget:
            yield from ((str(path), p) for p in CUTTERS.get(kind, cut_text)(text, budget))
            continue
        if not held:
            begun = str(path)
        held.append(text)
        used += t
    if held:
        yield begun, "\n\n".join(held)


def boundaries(text: str, strategy: str) -> list[tuple[int, str]]:
    """(offset, path) of places where a chunk may begin."""
    path, found, before = Path(), [], None
    for line in walk(text):
        balanced = strategy == "balanced"
        if line.fence and balanced:
            found.append((line.at, str(path)))
        elif line.kind == "text":
            if h := atx(line.text):
                path.enter(*h)
                if balanced or h[0] <= 3:
                    found.append((line.at, str(path)))
            elif balanced and before is not None and not trim_text(line.text) and trim_text(before):
                found.append((line.at, str(path)))
        before = line.text
    return found


def scan(text: str, budget: int, strategy: str) -> Iterator[tuple[str, str]]:
    """(path, text) of chunks of a document without blocks.

    At a boundary, if what runs on to the next one is too long, a chunk ends
    there or, if it has just begun, is cut. A section in the middle that is too
    long by itself is looked at only together with the next one, so it can pass
    whole: the budget holds for the rest.
    """
    start, path = 0, ""
    marks = boundaries(text, strategy)
    for i, (at, here) in enumerate(marks):
        if at == start and here:
            path = here
        end = marks[i + 1][0] if i + 1 < len(marks) else len(text)
        piece = trim_text(text[start:end])
        if tokens_of(piece) <= budget:
            continue
        if i > 0 and at > start:
            if done := trim_text(text[start:at]):
                yield path, done
            start, path = at, here or path
        else:
            yield from ((path, p) for p in cut_text(piece, budget))
            start = end
    if rest := trim_text(text[start:]):
        yield from ((path, p) for p in (cut_text(rest, budget) if tokens_of(rest) > budget else [rest]))


def merge_small(chunks: list[tuple[str, str]], budget: int) -> list[tuple[str, str]]:
    """Neighbours of one path merged if the first is small and both fit well: one pass, each chunk once."""
    out, i = [], 0
    sizes = [tokens_of(t) for _, t in chunks]
    while i < len(chunks):
        path, text = chunks[i]
        if i + 1 < len(chunks) and chunks[i + 1][0] == path and sizes[i] < budget * SMALL and sizes[i] + sizes[i + 1] < budget * MERGED:
            text, i = f"{text}\n\n{chunks[i + 1][1]}", i + 1
        out.append((path, text))
        i += 1
    return out


def chunk_text(text: str, blocks: list[dict] | None, budget: int, strategy: str = "headings_first") -> list[tuple[str, str]]:
    """(path, text) of a document's chunks: packed blocks if it has any, else a scan and one merge."""
    if blocks and any(trim_text(b["text"]) for b in blocks):
        return list(pack_blocks(blocks, budget, strategy))
    return merge_small(list(scan(text, budget, strategy)), budget)


def chunk(packets: DataFrame, max_tokens: int = 4000, margin_ratio: float = 0.1, strategy: str = "headings_first", own_blocks: bool = False) -> DataFrame:
    """Chunk sets of packets: ``source_id, original_url, key_blocks, max_tokens, total_chunks, total_est_tokens, chunks``.

    One row a packet and no shuffle; explode ``chunks`` for a table of chunks.
    Null content has none. With ``own_blocks`` packets need no ``key_blocks``:
    the content's are made where it is chunked and not returned.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}, not {strategy!r}")
    budget = budget_of(max_tokens, margin_ratio)
    kept = [c for c in ("source_id", "original_url", "key_blocks") if c in packets.columns and not (own_blocks and c == "key_blocks")]
    given = [F.col("source_id").cast("string"), F.col("content")]
    if "key_blocks" in kept:
        given.append(F.transform("key_blocks", lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"))))

    def run(i: str | None, text: str | None, blocks: list[dict] | None = None) -> list[dict]:
        if own_blocks:
            blocks = [dict(kind=kind, text=body) for _, kind, body, _ in blocks_of(text or "")]
        return [
            dict(chunk_id=f"{i}:c{k}", chunk_index=k, headings_path=p, est_tokens=tokens_of(t), text=t, char_len=units_of(t))
            for k, (p, t) in enumerate(chunk_text(text or "", blocks, budget, strategy))
        ]

    made = with_made(packets, "chunks", K.CHUNKS, run, given, kept)
    total = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c["est_tokens"])
    return made.select(*kept, F.lit(max_tokens).alias("max_tokens"), F.size("chunks").alias("total_chunks"), total.alias("total_est_tokens"), "chunks")


def get_chunk(sets: DataFrame, index: int) -> DataFrame:
    """The chunk of a number of each set that has it."""
    return sets.select("source_id", F.explode("chunks").alias("c")).select("source_id", "c.*").where(F.col("chunk_index") == index)


def search_chunks(sets: DataFrame, term: str) -> DataFrame:
    """Chunks that hold a term, in any case."""
    return sets.select("source_id", F.explode("chunks").alias("c")).select("source_id", "c.*").where(F.contains(F.lower("text"), F.lower(F.lit(term))))
