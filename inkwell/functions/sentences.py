"""Sentences, their salience, and what is chosen from them: in one row, without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import Rx, ascii_only, even, let, trim, units
from .tokens import est_tokens

HEADING, LIST = Rx(r"^#{1,6}\s+"), Rx(r"^[-*+]\s+|^[0-9]+[.)]\s+")
#: Where sentences part in a text whose white space is single blanks; it starts at the blank, as that fails soonest.
BETWEEN = Rx(r" (?<=[.!?] )(?=[A-Z])")
FENCE = Rx(r"^\s*(```+|~~~+)")
PRESERVE = ("numbers", "dates", "names")
_BREAK = "\u0001"

#: What a sentence is scored by: (kind to preserve, or "" for always; pattern; points).
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
SALIENCE: tuple[tuple[str, Rx, int], ...] = (
    ("numbers", Rx(r"\d+"), 2),
    ("dates", Rx(rf"\d{{4}}|{MONTHS}", "i"), 2),
    ("names", Rx(r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"), 1),
    ("definitions", Rx(r"means|refers to|is defined as|is called", "i"), 3),
    ("procedures", Rx(r"step|first|then|next|finally|must|should", "i"), 2),
    ("", Rx(r"according to|reported|announced|discovered|found that", "i"), 1),
    ("", Rx(r"\$[\d,]+|percent|\d+%", "i"), 2),
)
#: The same for sections.
SECTION: tuple[tuple[str, Rx, int], ...] = (
    ("", Rx(r"^#{1,3}\s"), 2),
    ("numbers", Rx(r"\d+"), 1),
    ("dates", Rx(rf"\d{{4}}|{MONTHS}", "i"), 1),
    ("definitions", Rx(r"means|refers to|is defined as|is called", "i"), 2),
    ("procedures", Rx(r"step|first|then|next|finally|must|should", "i"), 1),
    ("", Rx(r"```"), 1),
    ("", Rx(r"^[-*]\s", "m"), 1),
)
#: For patterns above, lower-case words of which every match holds one, looked for before the pattern is tried; and whether a word is a match.
WORDS: dict[str, tuple[tuple[str, ...], bool]] = {
    r"means|refers to|is defined as|is called": (("means", "refers to", "is defined as", "is called"), True),
    r"step|first|then|next|finally|must|should": (("step", "first", "then", "next", "finally", "must", "should"), True),
    r"according to|reported|announced|discovered|found that": (("according to", "reported", "announced", "discovered", "found that"), True),
    r"\$[\d,]+|percent|\d+%": (("$", "percent", "%"), False),
}
_NUMBER, _YEAR, _DATE = Rx(r"\d+"), Rx(r"\d{4}"), Rx(rf"\d{{4}}|{MONTHS}", "i")
_MONTHS = tuple(MONTHS.lower().split("|"))


def standalone(line: Column) -> Column:
    """Headings and list items are sentences of their own."""
    return (F.ascii(line) < 58) & (HEADING.test(line) | LIST.test(line))


def sentences(text: Column) -> Column:
    """Sentences of a text without fenced code, in order; see :func:`inkwell.operators.markdown.sentences` for any text.

    Lines are joined to paragraphs, which blank lines, headings and list items
    end; a paragraph is cut after ``.``, ``!`` or ``?`` before a capital letter.
    """
    marked = F.transform(
        F.transform(F.split(text, "\n"), trim),
        lambda x: F.when(x == "", F.lit(_BREAK)).when(standalone(x), F.concat(F.lit(_BREAK), x, F.lit(_BREAK))).otherwise(x),
    )
    parts = F.transform(F.split(F.array_join(marked, " "), _BREAK), lambda x: F.trim(even(x)))
    cut = F.transform(parts, lambda x: F.when(standalone(x), F.array(x)).otherwise(BETWEEN.split(x)))
    return F.filter(F.flatten(cut), lambda x: x != "")


def has_sentences(text: Column) -> Column:
    """Whether :func:`sentences` finds any: a character that is neither white space nor a break."""
    return Rx(rf"[^\s{_BREAK}]").test(text)


def _any(low: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w))
    return hit


def _matched(t: Column, rx: Rx) -> Column:
    """Whether a pattern matches: words are looked for first, which takes a tenth of its time.

    Lower case of ASCII is that of the pattern; elsewhere a letter may become
    one of ASCII that the pattern doesn't take for the same, so it decides.
    """
    if rx == _NUMBER:
        return t["digit"]
    if rx == _DATE:
        return (t["digit"] & _YEAR.test(t["text"])) | (_any(t["low"], _MONTHS) & (t["plain"] | rx.test(t["text"])))
    words, enough = WORDS.get(rx.pattern, ((), False))
    if not words:
        return rx.test(t["text"])
    return _any(t["low"], words) & ((t["plain"] | rx.test(t["text"])) if enough else rx.test(t["text"]))


def _points(text: Column, rules: Sequence[tuple[str, Rx, int]], preserve: Sequence[str]) -> Column:
    looked = F.struct(text.alias("text"), F.lower(text).alias("low"), ascii_only(text).alias("plain"), _NUMBER.test(text).alias("digit"))
    return let(looked, lambda t: sum((F.when(_matched(t, rx), n).otherwise(0) for kind, rx, n in rules if not kind or kind in preserve), F.lit(0)))


def points_of(text: str, rules: Sequence[tuple[str, Rx, int]], preserve: Sequence[str]) -> int:
    """As :func:`_points`, of one text."""
    low, score = text.lower() if (plain := text.isascii()) else "", 0
    for search, words, enough, n in _searches(tuple(rules), tuple(preserve)):
        if not plain or not words:
            score += n if search(text) else 0
        elif _has(low, words):
            score += n if enough or search(text) else 0
        elif words is _MONTHS:
            score += n if _YEAR.py.search(text) else 0
    return score


def _has(low: str, words: Sequence[str]) -> bool:
    for w in words:
        if w in low:
            return True
    return False


@cache
def _searches(rules: tuple, preserve: tuple) -> list[tuple]:
    """Of the rules that are used: (pattern's search, words, whether a word is a match, points)."""
    used = [(rx, n) for kind, rx, n in rules if not kind or kind in preserve]
    return [(rx.py.search, *((_MONTHS, True) if rx == _DATE else WORDS.get(rx.pattern, ((), False))), n) for rx, n in used]


def salience(sentence: Column, preserve: Sequence[str] = PRESERVE) -> Column:
    shape = let(units(sentence), lambda n: F.when((n < 20) | (n > 300), -1).otherwise(0))
    # both begin below ":", as in standalone
    mark = let(trim(sentence), lambda b: F.when(F.ascii(b) < 58, F.when(HEADING.test(b), 3).otherwise(0) + F.when(LIST.test(b), 1).otherwise(0)).otherwise(0))
    return (_points(sentence, SALIENCE, preserve) + shape + mark).cast("int")


def section_score(section: Column, preserve: Sequence[str] = PRESERVE) -> Column:
    size = units(section)
    return (_points(section, SECTION, preserve) + F.when((size > 100) & (size < 2000), 1).otherwise(0)).cast("int")


def lower(text: Column) -> Column:
    """Lower case of each letter by itself, as SQL has it: a dotted capital I is an i, not an i and a dot."""
    return F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))


def normal(text: Column) -> Column:
    """Lower-case ASCII letters and digits; everything else is one space."""
    return F.trim(F.regexp_replace(lower(text), "[^a-z0-9]+", " "))


def first_fit(units_: Column, most: int) -> Column:
    """Of structs (.., i, tokens, ..) in order of preference, those that still fit, whatever was skipped before."""
    kind = "struct<used:bigint,kept:array<int>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept")).cast(kind)
    return F.aggregate(
        units_, start,
        lambda a, u: F.when(
            a["used"] + u["tokens"] <= most,
            F.struct((a["used"] + u["tokens"]).alias("used"), F.concat(a["kept"], F.array(u["i"])).alias("kept")),
        ).otherwise(a),
    )


def scored(list_: Column, preserve: Sequence[str] = PRESERVE) -> Column:
    """Structs (order, i, tokens, s), best first and then in order of the text."""
    return F.sort_array(  # by its own order; array_sort would interpret a comparison
        F.transform(list_, lambda s, i: F.struct((-salience(s, preserve)).alias("order"), i.alias("i"), est_tokens(s).alias("tokens"), s.alias("s")))
    )


def _firsts(list_: Column, keep_nameless: bool) -> Column:
    """The first of each normal form, in order: one fold, each form made once."""
    start = F.struct(F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("kept"))
    pairs = F.transform(list_, lambda s: F.struct(normal(s).alias("n"), s.alias("s")))

    def step(a: Column, p: Column) -> Column:
        known = F.array_contains(a["names"], p["n"])
        skip = (known & (p["n"] != "")) if keep_nameless else (known | (p["n"] == ""))
        more = F.struct(F.concat(a["names"], F.array(p["n"])).alias("names"), F.concat(a["kept"], F.array(p["s"])).alias("kept"))
        return F.when(skip, a).otherwise(more)

    return F.aggregate(pairs, start, step, lambda a: a["kept"])


def dedupe(list_: Column) -> Column:
    """The first of each normal form; sentences without letters and digits go."""
    return _firsts(list_, keep_nameless=False)


def summary_text(list_: Column) -> Column:
    """Headings and items on their own, other sentences joined to paragraphs, blank lines between."""
    mark = F.transform(
        F.filter(F.transform(list_, trim), lambda s: s != ""),
        lambda s: F.when(standalone(s), F.concat(F.lit(_BREAK), s, F.lit(_BREAK))).otherwise(s),
    )
    parts = F.filter(F.transform(F.split(F.array_join(mark, " "), _BREAK), trim), lambda s: s != "")
    return F.array_join(parts, "\n\n")


def picked(list_: Column, kept: Column) -> Column:
    """Sentences of the numbers ``kept``, in order of the text."""
    return let(list_, lambda x: F.transform(F.array_sort(kept), lambda i: F.get(x, i)))


# --- questions ---------------------------------------------------------------

#: Words that ask nothing, and endings in the order they are tried.
STOP_WORDS = frozenset(
    "what how why when where who which is are was were be been being have has had do does did a an the and or but in on at to for "
    "of with by from as into through can could should would will this that these those i me my we our you your".split()
)
ENDINGS = ("ments", "ment", "tions", "tion", "ations", "ation", "ings", "ing", "ers", "er", "ed", "es", "s")


def question_terms(question: str) -> list[str]:
    """Words of a question that mean something; short ones only with a capital or a digit. In order, once each."""
    found = {}
    for raw in re.findall("[A-Za-z0-9]+", question):
        short = len(raw) <= 2 and not re.search("[A-Z0-9]", raw)
        if raw.lower() not in STOP_WORDS and not short:
            found[raw.lower()] = None
    return list(found)


def stem(term: str) -> str:
    if len(term) <= 4:
        return term
    if term.endswith("ies"):
        return term[:-3] + "y"
    ending = next((e for e in ENDINGS if term.endswith(e) and len(term) > len(e) + 2), "")
    return term[: len(term) - len(ending)]


def variants(term: str) -> list[str]:
    """The term and its stem."""
    return [v for v in dict.fromkeys((term, stem(term))) if len(v) > 1]


def term_matches(sentence: Column, terms: Sequence[str]) -> Column:
    """How many terms stand in a sentence: a variant as a word or, from 4 letters on, as a word's beginning."""
    hits, forms_of = [], [v for term in terms for v in variants(term)]
    for term in terms:
        forms = [f" {v}" if len(v) >= 4 else f" {v} " for v in variants(term)]
        hits.append(forms)

    def count(padded: Column) -> Column:
        return sum((_any(padded, forms).cast("int") for forms in hits), F.lit(0))

    # a sentence without any of the words, as they are, has no normal form with one
    some = let(lower(sentence), lambda low: _any(low, forms_of))
    return F.when(some, let(F.concat(F.lit(" "), normal(sentence), F.lit(" ")), count)).when(sentence.isNotNull(), 0)


def relevant(list_: Column, terms: Sequence[str], preserve: Sequence[str] = PRESERVE) -> Column:
    """Structs (order, less, i, tokens, s) by relevance to the terms, which neighbours add to."""

    def unit(s: Column, i: Column, counts: Column) -> Column:
        own = F.get(counts, i)
        near = F.coalesce(F.get(counts, i - 1), F.lit(0)) + F.coalesce(F.get(counts, i + 1), F.lit(0))
        score = salience(s, preserve) + own * 3 + F.when((own > 0) & HEADING.test(trim(s)), 2).otherwise(0) + F.least(F.lit(2), near)
        return F.struct((-score).alias("order"), (-own).alias("less"), i.alias("i"), est_tokens(s).alias("tokens"), s.alias("s"))

    both = F.struct(list_.alias("list"), F.transform(list_, lambda s: term_matches(s, terms)).alias("counts"))
    return let(both, lambda x: F.sort_array(F.transform(x["list"], lambda s, i: unit(s, i, x["counts"]))))


# --- quotations --------------------------------------------------------------

_JSON_KEY = Rx(r"^[\"'][^\"']+[\"']\s*:")
_JSON_ANY = Rx(r"[\"'][^\"']+[\"']\s*:")
QUOTED = Rx('"([^"]{20,200})"')


def json_like(line: Column) -> Column:
    bare = trim(line)
    return _JSON_KEY.test(bare) | (bare.startswith("{") & _JSON_ANY.test(bare))


def likely_quote(text: Column) -> Column:
    bare = trim(text)
    symbols = F.regexp_count(bare, F.lit(r"[{}\[\]<>:=;]"))
    return (
        (Rx(r"\S+").count(bare) >= 4) & (F.regexp_count(bare, F.lit("[A-Za-z]")) >= 10) & (symbols / units(bare) <= 0.2)
        & ~bare.rlike(r"\\[nrtu]") & ~bare.rlike("(?i)https?://")
    )


def quotes(text: Column, most: int = 5) -> Column:
    """The first quotations of a text without code: 20 to 200 characters, likely speech, once each."""
    per_line = F.transform(
        F.filter(F.split(F.regexp_replace(text, "`[^`]*`", ""), "\n"), lambda x: ~json_like(x)),
        lambda x: F.filter(F.transform(QUOTED.all(x, 1), trim), likely_quote),
    )
    return F.slice(_firsts(F.flatten(per_line), keep_nameless=True), 1, most)


def key_points(list_: Column, preserve: Sequence[str] = PRESERVE, most: int = 10) -> Column:
    """The first distinct sentences of salience 2 or more."""
    return F.slice(dedupe(F.filter(list_, lambda s: salience(s, preserve) >= 2)), 1, most)


def citation(text: Column, blocks: Column) -> Column:
    """The id of the first block (block_id, .., text) that holds the text as it is or in normal form; '' if none."""

    def find(q: Column) -> Column:
        hit = F.filter(blocks, lambda b: F.contains(b["text"], q["bare"]) | ((q["form"] != "") & F.contains(normal(b["text"]), q["form"])))
        return F.when(q["bare"] == "", "").otherwise(F.coalesce(F.get(hit, F.lit(0))["block_id"], F.lit("")))

    return let(F.struct(trim(text).alias("bare"), normal(trim(text)).alias("form")), find)


def citations(texts: Column, blocks: Column) -> Column:
    """As :func:`citation` for each of an array of texts: the blocks' normal forms are made once for all of them."""
    known = F.transform(blocks, lambda b: F.struct(b["block_id"].alias("block_id"), b["text"].alias("text"), normal(b["text"]).alias("form")))

    def find(t: Column, b: Column) -> Column:
        def first(q: Column) -> Column:
            # the fold takes the first hit, and looks at no block after it
            hit = F.aggregate(b, F.lit(None).cast("struct<id:string>"), lambda a, x: F.when(a.isNotNull(), a).when(
                F.contains(x["text"], q["bare"]) | ((q["form"] != "") & F.contains(x["form"], q["form"])), F.struct(x["block_id"].alias("id"))))
            return F.when(q["bare"] == "", "").otherwise(F.coalesce(hit["id"], F.lit("")))

        return let(F.struct(trim(t).alias("bare"), normal(trim(t)).alias("form")), first)

    return let(known, lambda b: F.transform(texts, lambda t: find(t, b)))


def omission(text: Column) -> Column:
    """A label for what was left out: its heading, or its first line up to 57 characters."""
    line = trim(F.get(F.split(text, "\n"), F.lit(0)))
    return F.when(line.startswith("#"), F.concat(F.lit("Section: "), Rx(r"^#+\s*").replace(line, ""))).when(
        units(line) < 60, line
    ).otherwise(F.concat(F.substring(line, 1, 57), F.lit("...")))
