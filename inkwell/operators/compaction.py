"""Extractive summaries of a token budget, in four modes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinds as K
from ..functions import sentences as S
from ..functions.regex import let, settled, trim_text, units_of
from ..functions.rowwise import by_row
from ..functions.tokens import est_tokens, tokens_of, truncate, truncate_text
from .markdown import sections, sentences, sentences_column, standalone, without_code_column

MODES = ("structural", "salience", "map_reduce", "question_focused")
#: Tokens that must be left for a section to be summarised, and that its body gets at least.
LEAST_LEFT, LEAST_BODY = 40, 20
#: Omissions that are listed; the share of sentences that a round keeps, and where rounds end.
MOST_OMISSIONS, ROUND_KEEPS, ROUND_ENDS = 5, 0.8, 5
_OTHER = S.Rx("[^a-z0-9]+").py


# --- native: sentences chosen in their own row --------------------------------


def all_sentences(text: Column) -> Column:
    """Sentences of any text: expressions, and only for texts with fences the walk over lines."""
    fenced = text.rlike(r"(?m)" + S.FENCE.java)
    return F.when(fenced, sentences_column(F.when(fenced, text))).otherwise(S.sentences(text))


def select_salient(list_: Column, most: int, preserve: Sequence[str] = S.PRESERVE) -> Column:
    """(used, kept): the numbers of the sentences taken, best first, while they fit."""
    return S.first_fit(S.scored(list_, preserve), most)


def select_relevant(list_: Column, terms: Sequence[str], most: int, preserve: Sequence[str] = S.PRESERVE) -> Column:
    return S.first_fit(S.relevant(list_, terms, preserve), most)


# --- one text, for the modes that summarise within summaries ------------------


def points(text: str, rules, preserve: Sequence[str]) -> int:
    return S.points_of(text, rules, preserve)


def salience_of(sentence: str, preserve: Sequence[str]) -> int:
    size, bare = units_of(sentence), trim_text(sentence)
    score = points(sentence, S.SALIENCE, preserve) - (size < 20) - (size > 300)
    return score + 3 * bool(S.HEADING.py.search(bare)) + bool(S.LIST.py.search(bare))


def section_score_of(section: str, preserve: Sequence[str]) -> int:
    return points(section, S.SECTION, preserve) + (100 < units_of(section) < 2000)


def normal_of(text: str) -> str:
    return _OTHER.sub(" ", text.replace("\u0130", "i").lower()).strip(" ")


def summary_of(chosen: list[str]) -> str:
    """Distinct sentences as a text: headings and items alone, the others joined."""
    firsts: dict[str, str] = {}
    for s in chosen:
        if n := normal_of(s):
            firsts.setdefault(n, s)
    parts: list[str] = []
    joins = False
    for s in map(trim_text, firsts.values()):
        alone = standalone(s)
        if joins and not alone:
            parts[-1] += f" {s}"
        else:
            parts.append(s)
        joins = not alone
    return "\n\n".join(parts)


def fit(units: list[str], order: list[int], most: int) -> list[int]:
    """Numbers of the units that fit, tried in an order, in order of the text."""
    used, kept = 0, []
    for i in order:
        if used + (t := tokens_of(units[i])) <= most:
            used += t
            kept.append(i)
    return sorted(kept)


def best_first(units: list[str], score) -> list[int]:
    return sorted(range(len(units)), key=lambda i: (-score(units[i]), i))


def summarise(text: str, most: int, preserve: Sequence[str]) -> str:
    """A text of a budget: itself, its best sentences, or its beginning."""
    if most <= 0:
        return ""
    if tokens_of(text) <= most:
        return text
    units = sentences(text)
    if len(units) > 3:
        kept = fit(units, best_first(units, lambda s: salience_of(s, preserve)), most)
        if summary := summary_of([units[i] for i in kept]):
            return summary
    return truncate_text(text, most)[0]


def summarise_section(section: str, most: int, preserve: Sequence[str]) -> str:
    """As :func:`summarise`, but a heading stays."""
    if tokens_of(section) <= most:
        return section
    first, _, rest = section.partition("\n")
    head = trim_text(first) if S.HEADING.py.search(trim_text(first)) else ""
    body = trim_text(rest if head else section)
    if not body:
        return head
    short = summarise(body, max(LEAST_BODY, most - (tokens_of(head) if head else 0)), preserve)
    return "\n\n".join(x for x in (head, short) if x)


def label_of(text: str) -> str:
    line = trim_text(text.split("\n")[0])
    if line.startswith("#"):
        return f"Section: {S.Rx(r'^#+\s*').py.sub('', line)}"
    return line if units_of(line) < 60 else f"{line[:57]}..."


def structural(text: str, most: int, preserve: Sequence[str]) -> tuple[str, list[str]]:
    """(summary, omissions): best sections whole, the next ones in short, the rest named."""
    parts, left, kept, omitted = sections(text), most, {}, []
    for i in best_first(parts, lambda s: section_score_of(s, preserve)):
        part, t = parts[i], tokens_of(parts[i])
        if left > 0 and t <= left:
            kept[i] = part
            left -= t
            continue
        if left >= LEAST_LEFT:
            short = summarise_section(part, left, preserve)
            if 0 < (t := tokens_of(short)) <= left:
                kept[i] = short
                left -= t
                omitted.append(f"Summarized {label_of(part)}")
                continue
        omitted.append(label_of(part))
    return "\n\n".join(kept[i] for i in sorted(kept)), omitted[:MOST_OMISSIONS]


def map_reduce(chunks: list[str], content: str, most: int, preserve: Sequence[str]) -> tuple[str, list[str], list[str]]:
    """(summary, omissions, warnings): equal budgets for all chunks, then fewer sentences round by round."""
    each, warnings = most // max(1, len(chunks)), []
    if each < 1:
        each = 1
        warnings.append(f"Chunk count ({len(chunks)}) exceeds token budget ({most}); using minimum per-chunk budget")
    text = trim_text("\n\n".join(summarise(c, each, preserve) for c in chunks))
    if not text and trim_text(content):
        warnings.append("Map-reduce produced empty chunk summaries; falling back to truncated content")
        text = truncate_text(content, max(1, most))[0]
    known: dict[str, int] = {}  # a round has most sentences of the one before

    def salience(s: str) -> int:
        if s not in known:
            known[s] = salience_of(s, preserve)
        return known[s]

    while tokens_of(text) > most:
        units = sentences(text)
        keep = math.floor(len(units) * ROUND_KEEPS)
        text = " ".join(units[i] for i in sorted(best_first(units, salience)[:keep]))
        if keep <= ROUND_ENDS:
            break
    return text, [f"Combined {len(chunks)} chunks via map-reduce"], warnings


# --- the operator --------------------------------------------------------------

_PARTS = K.struct(summary=K.STRING, omissions=K.STRINGS, warnings=K.STRINGS)


def compact(packets: DataFrame, max_tokens: int, mode: str = "structural", question: str | None = None, preserve: Sequence[str] = S.PRESERVE) -> DataFrame:
    """``source_id, original_url, compacted, est_tokens, success, error``: one row a packet or chunk set, no shuffle.

    Packets have ``content``, chunk sets have ``chunks``. A row without content
    or id is not summarised; it says so in ``error``. An unknown mode is
    structural.
    """
    from_chunks = "chunks" in packets.columns
    text = F.array_join(F.transform("chunks", lambda c: c["text"]), "\n\n") if from_chunks else F.col("content")
    chunks = F.transform("chunks", lambda c: c["text"]) if from_chunks else F.array("content")
    url = F.coalesce("original_url", F.lit("")) if "original_url" in packets.columns else F.lit("")
    none = F.array().cast("array<struct<block_id:string,kind:string,text:string,char_len:int>>")
    blocks = F.coalesce("key_blocks", none) if "key_blocks" in packets.columns else none
    rows = packets.select(
        F.col("source_id").cast("string").alias("source_id"), url.alias("original_url"),
        F.coalesce(text, F.lit("")).alias("text"), chunks.alias("chunks"), blocks.alias("blocks"),
        F.when(text.isNull(), "Compact input must include content or chunks").when(F.col("source_id").isNull(), "Compact input must include source_id").alias("error"),
    )
    empty = F.array().cast("array<string>")

    def parts(summary: Column, omissions: Column, warnings: Column) -> Column:
        return F.struct(summary.alias("summary"), omissions.alias("omissions"), warnings.alias("warnings"))

    if mode in ("salience", "question_focused"):
        terms = question_terms(question) if mode == "question_focused" else []
        fallback = None
        if mode == "question_focused" and not terms:
            fallback = "No meaningful question terms found, falling back to salience compaction" if question else "No question provided, falling back to salience compaction"

        # every value is bound once: as columns of columns, later ones would repeat earlier ones over and over
        def made(units: Column) -> Column:
            return let(F.exists(units, lambda s: S.term_matches(s, terms) > 0) if terms else F.lit(False), lambda hit: let(chosen(units, hit), lambda picked: said(units, hit, picked)))

        def chosen(units: Column, hit: Column) -> Column:
            best = select_salient(units, max_tokens, preserve)
            return F.when(hit, select_relevant(units, terms, max_tokens, preserve)).otherwise(best) if terms else best

        def said(units: Column, hit: Column, picked: Column) -> Column:
            n, k = F.size(units).cast("string"), F.size(picked["kept"]).cast("string")
            condensed = F.array(F.concat(F.lit("Condensed from "), n, F.lit(" sentences to "), k))
            focus = F.array(F.lit(f'Focused on question: "{(question or "")[:50]}..."'), F.concat(F.lit("Selected "), k, F.lit(" of "), n, F.lit(" sentences")))
            missed = F.array(F.lit("No sentence matched question terms, falling back to salience compaction"))
            notes = F.array(F.lit(fallback)) if fallback else F.when(hit, empty).otherwise(missed) if terms else empty
            return parts(S.summary_text(S.dedupe(S.picked(units, picked["kept"]))), F.when(hit, focus).otherwise(condensed), notes)

        rows = rows.withColumn("made", settled(let(all_sentences(F.col("text")), made)))
    else:

        # one argument, and no text twice: a content of chunks is what they join to
        @by_row(_PARTS)
        def run(given: str | list[str | None]) -> tuple:
            if mode == "map_reduce":
                some = [x for x in given if x is not None]
                return map_reduce(some, "\n\n".join(some), max_tokens, preserve)
            return (*structural(given, max_tokens, preserve), [])

        # settled, so that it is made once and not again, with all that it is made from, for each column that uses it
        rows = rows.withColumn("made", settled(run(F.coalesce("chunks", empty) if mode == "map_reduce" else F.col("text"))))
    over = est_tokens(F.col("made.summary")) > max_tokens
    rows = rows.withColumn("summary", settled(F.when(over, truncate(F.col("made.summary"), max_tokens)["text"]).otherwise(F.col("made.summary"))))
    cut_note = F.array(F.lit("Summary truncated to fit token budget"))
    warnings = F.when(over, F.concat("made.warnings", cut_note)).otherwise(F.col("made.warnings"))

    def cited(texts: Column, quote: str) -> Column:
        return F.transform(texts, lambda t: F.struct(F.concat(F.lit(quote), t, F.lit(quote)).alias("text"), S.citation(t, F.col("blocks")).alias("citation")))

    rows = rows.withColumn("summary_units", all_sentences(F.col("made.summary")))
    points_ = cited(S.key_points(F.col("summary_units"), preserve), "")
    spoken = F.filter("blocks", lambda b: (b["text"] != "") & ~b["kind"].isin("code", "table", "meta"))
    sources = F.when(F.size("blocks") > 0, F.array_join(F.transform(spoken, lambda b: b["text"]), "\n")).otherwise(F.col("text"))
    rows = rows.withColumn("sources", sources)
    bare = F.when(F.contains("sources", F.lit("```")) | F.contains("sources", F.lit("~~~")), without_code_column("sources")).otherwise(F.col("sources"))
    rows = rows.withColumn("bare", bare)
    rows = rows.withColumn("key_points", settled(points_)).withColumn("quotes", cited(S.quotes(F.col("bare")), '"'))
    said = F.concat(F.col("summary"), F.array_join(F.transform("key_points", lambda k: k["text"]), " "))
    packed = F.struct(
        F.col("summary"), F.col("key_points"), F.col("quotes").alias("important_quotes"), F.col("made.omissions").alias("omissions"), warnings.alias("warnings"),
    )
    ok = F.col("error").isNull()
    return rows.select(
        "source_id", "original_url", F.when(ok, packed).alias("compacted"), F.when(ok, est_tokens(said)).alias("est_tokens"), ok.alias("success"), "error",
    )


def question_terms(question: str | None) -> list[str]:
    return S.question_terms(question or "")
