"""The token estimate that all budgets are counted in, and what goes with it."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import SPACES, Rx, ascii_only, let, trim, trim_text, units, units_of, word_count

#: Characters a token of text and of code, words a token, wide characters a token.
TEXT_CHARS, CODE_CHARS, TOKEN_WORDS, WIDE_CHARS = 3.5, 3.0, 0.75, 1.5
#: The ranges of wide (Chinese, Japanese, Korean) characters.
WIDE_RANGES = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF),
    (0x2CEB0, 0x2EBEF), (0x30000, 0x3134F), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xAC00, 0xD7AF),
)
WIDE = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in WIDE_RANGES) + "]"
#: Signs of code in a text, one point each.
CODE_SIGNS = (
    Rx(r"^\s*(function|const|let|var|class|import|export|def|async|await)\s", "m"), Rx(r"[{}\[\]();]"), Rx(r"=>"),
    Rx(r"^\s*#include", "m"), Rx(r"^\s*package\s+", "m"), Rx(r"^\s*use\s+", "m"),
)
INDENTED = Rx(r"^\s{2,}")
#: The shares of indented and of short lines that must be passed, in tenths: as a double, 0.7 of 90 lines is less than 63.
INDENTED_TENTHS, SHORT_TENTHS = 3, 7
#: What any of the signs needs: a text with none of these is no code, whatever its lines look like.
_BRACKET = CODE_SIGNS[1]
_KEYWORD = Rx(r"^\s*(?:(?:function|const|let|var|class|import|export|def|async|await)\s|#include|package\s|use\s)", "m")


def is_code(text: Column) -> Column:
    """At least three signs of code, of which indented and short lines are two."""
    parts = F.split(text, "\n")
    n = F.size(parts)
    indented = F.size(F.filter(parts, INDENTED.test))
    short = F.size(F.filter(parts, lambda x: units(x) < 80))
    points = [s.test(text) for s in CODE_SIGNS] + [indented * 10 > n * INDENTED_TENTHS, short * 10 > n * SHORT_TENTHS]
    # lines give two points at most, so a sign is needed before they are looked at
    return F.when(F.contains(text, F.lit("=>")) | _BRACKET.test(text) | _KEYWORD.test(text), sum((p.cast("int") for p in points), F.lit(0)) >= 3).when(text.isNotNull(), False)


def est_tokens(text: Column) -> Column:
    """Estimated tokens, as a long; 0 for null and empty texts."""

    def count(t: Column) -> Column:
        text, rest = t["text"], t["rest"]
        wide = F.length(text) - F.length(rest)
        by_chars = F.ceil(units(rest) / F.when(is_code(text), CODE_CHARS).otherwise(TEXT_CHARS))
        by_words = F.ceil(word_count(rest) / TOKEN_WORDS)
        return F.coalesce(F.greatest(by_chars, by_words) + F.ceil(wide / WIDE_CHARS), F.lit(0)).cast("long")

    rest = F.when(ascii_only(text), text).otherwise(F.regexp_replace(text, WIDE, ""))
    return let(F.struct(text.alias("text"), rest.alias("rest")), count)


def reading_minutes(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(word_count(text) / 225)).cast("long")


def last_index(text: Column, part: str) -> Column:
    """Where ``part`` starts last, from 0; -1 if it doesn't."""
    at = F.locate(part[::-1], F.reverse(text))
    return F.when(at > 0, F.length(text) - at - len(part) + 1).otherwise(-1)


SENTENCE_END = Rx(r"[.!?]\s+[A-Z][^.!?]*$")


def truncate(text: Column, most: int) -> Column:
    """(text, truncated): cut to about ``most`` tokens, at a paragraph, sentence or line end if one is near.

    Positions count code points; texts with characters beyond U+FFFF can
    therefore be cut a little later than by UTF-16 units.
    """

    # every value is bound once: the place of the cut would repeat the token count some twenty times
    def aimed(t: Column) -> Column:
        goal = F.floor(units(t["text"]) * (F.lit(float(most)) / t["now"]) * 0.95).cast("int")
        cut = let(goal, lambda g: let(F.struct(g.alias("goal"), F.substring(t["text"], F.lit(1), F.greatest(g, F.lit(0))).alias("head")), ended))
        whole = t["now"] <= most
        return F.struct(F.when(whole, t["text"]).otherwise(cut).alias("text"), (~whole).alias("truncated"))

    def ended(h: Column) -> Column:
        goal, head = h["goal"], h["head"]
        places = F.struct(
            last_index(head, "\n\n").alias("paragraph"), (F.regexp_instr(head, F.lit(SENTENCE_END.java)) - 1).alias("sentence"), last_index(head, "\n").alias("line"),
        )
        return let(places, lambda p: trim(F.substring(head, F.lit(1), F.when(p["paragraph"] > goal * 0.8, p["paragraph"]).when(
            p["sentence"] > goal * 0.8, p["sentence"] + 1).when(p["line"] > goal * 0.9, p["line"]).otherwise(goal).cast("int"))))

    return let(F.struct(text.alias("text"), est_tokens(text).alias("now")), aimed)


# --- the same for one Python string, for the machines that walk over lines ---


_WIDE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in WIDE_RANGES) + "]")
#: White space that splitting bytes doesn't see.
_OTHER_SPACE = re.compile("[" + "".join(c for c in SPACES if c > "\x7f") + "]")


def code_text(text: str) -> bool:
    # lines give two points at most, so a sign is needed before they are looked at
    if not ("=>" in text or _BRACKET.py.search(text) or (_KEYWORD.py.search if "\n" in text else _KEYWORD.py.match)(text)):
        return False
    parts = text.split("\n")
    points = sum(bool(s.py.search(text)) for s in CODE_SIGNS)
    points += sum(bool(INDENTED.py.match(x)) for x in parts) * 10 > len(parts) * INDENTED_TENTHS
    points += sum(units_of(x) < 80 for x in parts) * 10 > len(parts) * SHORT_TENTHS
    return points >= 3


def words_of(text: str) -> int:
    """Runs of anything but white space; bytes are split where they hold none beyond ASCII."""
    if not text.isascii():
        text = _OTHER_SPACE.sub(" ", text)
    return len(text.encode("utf-8", "surrogatepass").split())


def tokens_of(text: str) -> int:
    if not text:
        return 0
    wide = 0 if text.isascii() else len(_WIDE.findall(text))
    rest = _WIDE.sub("", text) if wide else text
    by_chars = math.ceil(units_of(rest) / (CODE_CHARS if code_text(text) else TEXT_CHARS))
    return max(by_chars, math.ceil(words_of(rest) / TOKEN_WORDS)) + math.ceil(wide / WIDE_CHARS)


def truncate_text(text: str, most: int) -> tuple[str, bool]:
    now = tokens_of(text)
    if now <= most:
        return text, False
    goal = math.floor(units_of(text) * (most / now) * 0.95)
    head = text[:goal]
    end = SENTENCE_END.py.search(head)
    if (at := head.rfind("\n\n")) > goal * 0.8:
        head = head[:at]
    elif end and end.start() > goal * 0.8:
        head = head[: end.start() + 1]
    elif (at := head.rfind("\n")) > goal * 0.9:
        head = head[:at]
    return trim_text(head), True
