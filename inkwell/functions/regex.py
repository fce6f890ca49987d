"""One spelling of a regular expression for three engines.

Patterns are written as browsers' scripts understand them: ``\\s`` is all
Unicode white space, ``\\b`` and ``\\w`` are ASCII, ``$`` is the very end. Java
(Spark), RE2 (DuckDB) and Python each need another spelling of that.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as code points and ranges.
SPACE_RANGES = ((9, 13), (32, 32), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
SPACES = "".join(chr(c) for a, b in SPACE_RANGES for c in range(a, b + 1))
_SPACE = "".join(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in SPACE_RANGES)
_START = r"(?<![A-Za-z0-9_])"
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


@dataclass(frozen=True)
class Rx:
    pattern: str
    flags: str = ""

    def _spelled(self, edge: str, end: str) -> str:
        out, inside, i = [], False, 0
        text = self.pattern
        while i < len(text):
            c, two = text[i], text[i : i + 2]
            if two == r"\s":
                out.append(_SPACE if inside else f"[{_SPACE}]")
            elif two == r"\S":
                out.append(f"[^{_SPACE}]")
            elif two == r"\w":
                out.append("A-Za-z0-9_" if inside else "[A-Za-z0-9_]")
            elif two == r"\d":
                out.append("0-9" if inside else "[0-9]")
            elif two == r"\b":
                # before a word's first character, looking back is enough
                first = not out or out[-1] in ("|", "(")
                out.append(_START if first and edge == _EDGE and re.match(r"[A-Za-z0-9(\[\\]", text[i + 2 :]) else edge)
            elif c == "\\":
                out.append(two)
            elif c == "$" and not inside and "m" not in self.flags:
                out.append(end)
                i += 1
                continue
            else:
                inside = (inside or c == "[") and not (c == "]" and inside)
                out.append(c)
                i += 1
                continue
            i += 2
        return (f"(?{self.flags})" if self.flags else "") + "".join(out)

    @cached_property
    def java(self) -> str:
        # Java's lines end at U+0085 and others, too, unless told not to
        return Rx(self.pattern, self.flags.replace("m", "md"))._spelled(_EDGE, r"\z")

    @cached_property
    def re2(self) -> str:
        return self._spelled(r"\b", r"\z")

    @cached_property
    def py(self) -> re.Pattern:
        text = self._spelled(_EDGE, r"\Z")
        return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", text))

    @property
    def duck(self) -> str:
        """A DuckDB string literal of the pattern."""
        return "'" + self.re2.replace("'", "''") + "'"

    def test(self, text: Column) -> Column:
        return text.rlike(self.java)

    def count(self, text: Column) -> Column:
        return F.regexp_count(text, F.lit(self.java))

    def all(self, text: Column, group: int = 0) -> Column:
        return F.regexp_extract_all(text, F.lit(self.java), group)

    def first(self, text: Column, group: int = 0) -> Column:
        return F.regexp_extract(text, self.java, group)

    def replace(self, text: Column, by: str) -> Column:
        return F.regexp_replace(text, self.java, by)

    def split(self, text: Column) -> Column:
        return F.split(text, self.java)


BLANKS = Rx(r"\s+")
#: White space that isn't a single blank, as Java spells it.
_UNEVEN = rf"[{_SPACE}]{{2,}}|[" + _SPACE.replace(r"\x{20}", "") + "]"


def even(text: Column) -> Column:
    """Every run of white space as one blank; single blanks, most of them, are passed over."""
    return F.regexp_replace(text, _UNEVEN, " ")
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def trim_text(text: str) -> str:
    return text.strip(SPACES)


def units(text: Column) -> Column:
    """Length in UTF-16 units, as a long."""
    return F.when(ascii_only(text), F.length(text)).otherwise(2 * F.length(text) - F.length(F.regexp_replace(text, ASTRAL, ""))).cast("long")


def ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def units_of(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def word_count(text: Column) -> Column:
    """Runs of anything but white space.

    A split needs a twentieth of the time of ``regexp_count``, which copies the
    whole text for every match. Where single blanks are the only white space, as
    in sentences, they are counted by what is left without them, which needs
    a twentieth of a split's.
    """
    many = F.array_size(F.array_remove(BLANKS.split(text), ""))

    def count(bare: Column) -> Column:
        return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "))) + 1)

    single = ascii_only(text) & ~F.contains(text, F.lit("  ")) & ~text.rlike(r"[\t-\r]")
    return F.when(single, let(F.trim(text), count)).otherwise(many).cast("long")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def settled(value: Column) -> Column:
    """``value`` as a column that later ones refer to instead of repeating it.

    The optimizer may write a column's expression into each later one that uses
    it, which grows without bound along a chain. It doesn't for one that could
    give another value each time, as a row's number might.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once.

    Inside a lambda an outer expression would be computed again for every
    element; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
