"""HTML, Markdown and plain text read by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import Rx, let, trim, units

#: Named entities, in the order they are decoded; ``&amp;`` comes early, so ``&amp;lt;`` is decoded twice.
ENTITIES = (
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"),
    ("&reg;", "®"), ("&trade;", "™"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&lsquo;", "‘"),
    ("&rsquo;", "’"), ("&ldquo;", '"'), ("&rdquo;", '"'),
)
#: What is dropped from HTML before its text is read.
INVISIBLE = (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>")
#: Classes, attributes and phrases of pages behind a paywall.
PAYWALL_CLASSES = ("paywall", "subscription-wall", "metered-paywall", "subscriber-only", "premium-content", "piano-paywall")
PAYWALL_ATTRIBUTES = ("data-paywall", "data-subscriber-content")
PAYWALL_PHRASES = (
    "subscribe to continue reading", "this content is for subscribers", "to read the full article", "sign up to read",
    "premium subscribers only", "members-only content",
)


def _number_entity(text: Column, pattern: str, base: int) -> Column:
    """Numeric entities of up to U+FFFF, each distinct one replaced."""
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))

    def one(done: Column, entity: Column) -> Column:
        digits = F.regexp_extract(entity, pattern, 1)
        value = (F.conv(digits, 16, 10) if base == 16 else digits).try_cast("long")
        raw = F.unhex(F.lpad(F.hex(F.pmod(value, F.lit(65536))), 4, "0"))
        return F.replace(done, entity, F.coalesce(F.decode(raw, "UTF-16BE"), F.lit("")))

    return F.when(F.size(codes) > 0, F.aggregate(codes, text, one)).otherwise(text)


def decode_entities(text: Column) -> Column:
    out = text
    for name, char in ENTITIES:
        out = F.regexp_replace(out, f"(?i){name}", char)
    return _number_entity(_number_entity(out, "&#([0-9]+);", 10), "(?i)&#x([0-9a-f]+);", 16)


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; entities decoded, white space collapsed."""
    out = html
    for pattern in INVISIBLE:
        out = F.regexp_replace(out, pattern, " ")
    return trim(Rx(r"\s+").replace(decode_entities(out), " "))


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def title(html: Column) -> Column:
    return trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def language(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?is)<html[^>]*?\blang\s*=\s*["']([^"']*)["']""", 1)


def meta(html: Column, name: str) -> Column:
    """A meta tag's content, by name or property; '' without it."""
    by_name = rf"""(?is)<meta[^>]*?\b(?:name|property)\s*=\s*["']{name}["'][^>]*?\bcontent\s*=\s*["']([^"']*)["']"""
    return F.regexp_extract(html, by_name, 1)


def head_metadata(html: Column) -> Column:
    """The head's usual metadata as a map, without what isn't there."""
    names = ("description", "keywords", "author", "og:title", "og:description", "og:image", "og:site_name", "article:published_time")
    values = [meta(html, n) for n in names]
    made = F.map_from_arrays(F.array(F.lit("title"), F.lit("language"), *map(F.lit, names)), F.array(title(html), language(html), *values))
    return F.map_filter(made, lambda k, v: v != "")


def heading_texts(html: Column) -> Column:
    """(level, text) of well-formed headings, in order."""
    rx = r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>"
    found = F.transform(
        F.regexp_extract_all(html, F.lit(rx), 0),
        lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), trim(Rx(r"\s+").replace(F.regexp_replace(h, "<[^>]+>", ""), " ")).alias("text")),
    )
    return F.filter(found, lambda h: h["text"] != "")


def paywalled(html: Column) -> Column:
    """A paywall's class or attribute, or one of its phrases in the text."""
    classes = "|".join(PAYWALL_CLASSES)
    by_class = html.rlike(rf"""(?is)<[a-z][^>]*\bclass\s*=\s*["'](?:[^"']*\s)?(?:{classes})(?:\s[^"']*)?["']""")
    hit = by_class | html.rlike(rf"(?is)<[a-z][^>]*\s(?:{'|'.join(PAYWALL_ATTRIBUTES)})[\s=>]")
    text = F.lower(visible_text(html))
    for phrase in PAYWALL_PHRASES:
        hit = hit | F.contains(text, F.lit(phrase))
    return hit


def strip_tags(text: Column) -> Column:
    """A feed's description as text."""
    out = F.regexp_replace(text, "<[^>]+>", "")
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return trim(Rx(r"\s+").replace(_number_entity(_number_entity(out, "&#([0-9]+);", 10), "(?i)&#x([0-9a-f]+);", 16), " "))


def safe_attribute(value: Column) -> Column:
    """Null for values that run or carry something."""
    return F.when(~F.lower(trim(value)).rlike("^(javascript|data|vbscript|file):"), value)


def clean_markdown(text: Column) -> Column:
    out = F.regexp_replace(text, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"(?m)[ \t]+$", "")
    out = F.regexp_replace(out, "(?m)^[•◦▪▸►]\\s*", "- ")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\(\s*\)", "$1")
    return trim(F.regexp_replace(out, r"(?m)^#{1,6}[ \t]*$", ""))


# --- Markdown -------------------------------------------------------------------

#: What is removed from Markdown, and what stands for it.
UNSAFE = (("script", r"(?is)<script.*?</script>", ""), ("style", r"(?is)<style.*?</style>", ""), ("iframe", r"(?is)<iframe.*?(</iframe>|/?>)", "[iframe removed]"))


def safe_markdown(text: Column) -> Column:
    """(markdown, scripts, styles, iframes): unsafe elements and event attributes gone, and how many there were."""
    out, counts = text, []
    for name, pattern, by in UNSAFE:
        counts.append(F.regexp_count(out, F.lit(pattern)).alias(f"{name}s"))
        out = F.regexp_replace(out, pattern, by)
    out = Rx(r"""\s+on\w+="[^"]*\"""", "i").replace(out, "")
    out = Rx(r"""\s+on\w+='[^']*'""", "i").replace(out, "")
    return F.struct(F.regexp_replace(out, r"```(\w+)([^\n\w])", "```$1\n$2").alias("markdown"), *counts)


#: Markdown marks and what is left of them, in order.
PLAIN = (
    (r"(?s)```.*?```", " [code block] "), (r"`[^`]+`", " "), (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\[[^\]]*\]", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"),
    (r"~~([^~]+)~~", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^>\s*", ""), (r"(?m)^[-*_]{3,}$", ""), (r"(?m)^\s*[-*+]\s+", ""),
    (r"(?m)^\s*\d+\.\s+", ""), (r"\n{3,}", "\n\n"), (r"[ \t]+", " "),
)


def plain_markdown(text: Column) -> Column:
    out = text
    for pattern, by in PLAIN:
        out = Rx(pattern.partition(")")[2], pattern[2]).replace(out, by) if pattern.startswith("(?") else Rx(pattern).replace(out, by)
    return trim(out)


# --- plain text -------------------------------------------------------------------

#: Signs of code in a plain text, one point each; mean line length of code.
TEXT_CODE_SIGNS = (
    Rx(r"^(function|const|let|var|class|import|export|def|async|public|private|void)\s", "m"), Rx(r"[{}\[\]();]"), Rx(r"=>"),
    Rx(r"^\s*(if|for|while|switch|try|catch)\s*\(", "m"), Rx(r"^\s*#include", "m"), Rx(r"^\s*package\s+", "m"), Rx(r"^\s*using\s+", "m"), Rx(r"^\s*require\s*\(", "m"),
)
BULLETS = "-*•◦▪►"


def normal_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def looks_like_code(text: Column) -> Column:
    parts = F.split(text, "\n")
    n = F.size(parts)
    indented = F.size(F.filter(parts, lambda x: Rx(r"^\s{2,}").test(x))) > n * 0.4
    mean = (units(text) - (n - 1)) / n < 60
    points = [s.test(text) for s in TEXT_CODE_SIGNS] + [indented, mean]
    return sum((p.cast("int") for p in points), F.lit(0)) >= 3


def capitals(line: Column) -> Column:
    bare = trim(line)
    return (bare != "") & (units(bare) < 80) & (bare == F.upper(bare)) & bare.rlike("[A-Z]")


def text_structure(text: Column) -> Column:
    """Headings, lists, indented code, lines and their mean length, and whether all of it is code."""
    return let(F.split(text, "\n"), lambda parts: _structure(text, parts))


def _structure(text: Column, parts: Column) -> Column:
    def pair(x: Column, i: Column) -> Column:
        return F.struct(x.alias("line"), trim(F.coalesce(F.get(parts, i + 1), F.lit(""))).alias("after"), F.coalesce(F.get(parts, i - 1), F.lit("")).alias("before"))

    pairs = F.transform(parts, pair)
    full = F.filter(parts, lambda x: trim(x) != "")
    total = F.aggregate(full, F.lit(0).cast("long"), lambda a, x: a + units(x))
    return F.struct(
        F.exists(pairs, lambda p: capitals(p["line"]) | ((trim(p["line"]) != "") & p["after"].rlike("^(=+|-+)$"))).alias("has_headings"),
        F.exists(parts, lambda x: Rx(rf"^\s*[{BULLETS}]\s+").test(x)).alias("has_bullet_lists"),
        F.exists(parts, lambda x: Rx(r"^\s*\d+[.)]\s+").test(x)).alias("has_numbered_lists"),
        F.exists(pairs, lambda p: Rx(r"^\s{4,}").test(p["line"]) & (trim(p["before"]) != "") & ~Rx(r"^\s{4,}").test(p["before"])).alias("has_code_blocks"),
        F.size(parts).alias("line_count"),
        F.when(F.size(full) > 0, total / F.size(full)).otherwise(0.0).alias("avg_line_length"),
        looks_like_code(text).alias("is_likely_code"),
    )


def title_case(text: Column) -> Column:
    """Lower case, with a capital after every place where no ASCII word character stands before one."""
    return F.aggregate(
        F.split(F.lower(text), ""), F.struct(F.lit("").alias("out"), F.lit(False).alias("word")),
        lambda a, c: F.struct(F.concat(a["out"], F.when(~a["word"] & c.rlike("[a-z]"), F.upper(c)).otherwise(c)).alias("out"), c.rlike("[A-Za-z0-9_]").alias("word")),
        lambda a: a["out"],
    )


def text_title(text: Column) -> Column:
    """The first of five lines that is underlined, in capitals, or short without a full stop; null if none."""
    parts = F.slice(F.split(text, "\n"), 1, 5)

    def candidate(x: Column, i: Column) -> Column:
        bare, under = trim(x), trim(F.coalesce(F.get(parts, i + 1), F.lit("")))
        short = (units(bare) < 100) & ~F.contains(bare, F.lit("  ")) & ~bare.endswith(".")
        return F.when(bare == "", None).when(under.rlike(r"^(=+|-+)\z"), bare).when(capitals(x), title_case(bare)).when(short, bare)

    return F.get(F.filter(F.transform(parts, candidate), lambda t: t.isNotNull()), F.lit(0))


# --- packets ------------------------------------------------------------------------

MONTH_DATE = Rx(
    r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}"
    r"|\b\d{1,2}\/\d{1,2}\/\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b", "i")
NUMBER = Rx(r"\d+(?:,\d{3})*(?:\.\d+)?%?|\$\d+(?:,\d{3})*(?:\.\d+)?[KMB]?")


def source_summary(content: Column, outline: Column) -> Column:
    """Up to four lines: main topics, numbers and dates near the start, and the length in words."""
    top = F.slice(F.filter(outline, lambda e: e["level"] <= 2), 1, 5)
    start = F.substring(content, 1, 2000)
    numbers, dates = F.slice(F.array_distinct(NUMBER.all(start)), 1, 5), F.slice(F.array_distinct(MONTH_DATE.all(start)), 1, 3)
    words = F.size(Rx(r"\s+").split(content)).cast("string")

    def line(label: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, ", ")))

    return F.array_compact(F.array(
        line("Main topics: ", F.transform(top, lambda e: e["text"])), line("Key numbers mentioned: ", numbers), line("Dates mentioned: ", dates),
        F.concat(F.lit("Content length: ~"), words, F.lit(" words")),
    ))


def content_type(header: Column, body: Column) -> Column:
    """(type, mime_type, charset): by the header, else by how the body begins; ``text/plain`` isn't trusted."""
    parts = F.split(F.lower(header), ";")
    mime = trim(F.when(F.get(parts, F.lit(0)) == "", "application/octet-stream").otherwise(F.get(parts, F.lit(0))))
    charset = F.get(F.filter(F.transform(parts, trim), lambda p: p.startswith("charset=")), F.lit(0))
    charset = trim(F.split(charset, "=")[1])
    text = F.make_valid_utf8(body.cast("string"))
    start = F.make_valid_utf8(F.substring(body, 1, 1000).cast("string"))
    there = F.octet_length(body) > 0

    def kind(name: str, m: Column, c: Column = charset) -> Column:
        return F.struct(F.lit(name).alias("type"), m.alias("mime_type"), c.alias("charset"))

    none = F.lit(None).cast("string")
    return (
        F.when(F.contains(mime, F.lit("html")), kind("html", mime))
        .when(F.contains(mime, F.lit("markdown")), kind("markdown", mime))
        .when(mime == "application/pdf", kind("pdf", mime, none))
        .when((mime == "application/json") | mime.endswith("+json"), kind("json", mime))
        .when(F.contains(mime, F.lit("xml")), kind("xml", mime))
        .when(there & start.startswith("%PDF-"), kind("pdf", F.lit("application/pdf"), none))
        .when(there & start.rlike("(?i)<(!doctype|html|head|body)"), kind("html", F.lit("text/html")))
        .when(there & (trim(start).startswith("<?xml") | start.rlike("(?i)<rss|<feed|<atom")), kind("xml", F.lit("application/xml")))
        .when(there & Rx(r"^\s*[{\[]").test(start) & F.try_parse_json(text).isNotNull(), kind("json", F.lit("application/json")))
        .when(there & (start.rlike(r"^---\r?\n") | Rx(r"^#\s+").test(start) | start.rlike(r"^\[.+\]\(.+\)")), kind("markdown", F.lit("text/markdown")))
        .when(mime.startswith("text/"), kind("text", mime))
        .otherwise(kind("unknown", mime))
    )


#: Charsets by name.
CHARSETS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "utf-16": "UTF-16LE", "utf-16le": "UTF-16LE", "utf16le": "UTF-16LE", "us-ascii": "US-ASCII",
    "ascii": "US-ASCII", "latin1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1", "windows-1252": "ISO-8859-1",
}


def encoding(charset: Column) -> Column:
    """(encoding, note): a note if a charset isn't known and UTF-8 stands in for it."""
    name = F.lower(trim(charset))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in CHARSETS.items() for x in kv]), name)
    guess = F.when(name.startswith("utf-8"), "UTF-8").when(name.startswith("utf-16"), "UTF-16LE").when(
        F.contains(name, F.lit("1252")) | F.contains(name, F.lit("iso-8859")), "ISO-8859-1")
    found = F.coalesce(known, guess)
    note = F.when(charset.isNotNull() & (charset != "") & found.isNull(), F.concat(F.lit('Unsupported charset "'), charset, F.lit('", decoded as utf-8')))
    return F.struct(F.coalesce(found, F.lit("UTF-8")).alias("encoding"), note.alias("note"))


def decode_body(body: Column, charset: Column) -> Column:
    name = encoding(charset)["encoding"]
    return (
        F.when(name == "ISO-8859-1", F.decode(body, "ISO-8859-1")).when(name == "UTF-16LE", F.decode(body, "UTF-16LE"))
        .otherwise(F.make_valid_utf8(body.cast("string")))
    )


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def source_id(url: Column, retrieved_at: Column, hash_: Column) -> Column:
    """16 digits from the URL, the UTC day and the content, so that a day's copies of a page are one source."""
    return F.substring(F.sha2(F.concat_ws("|", url, F.date_format(retrieved_at, "yyyy-MM-dd"), hash_), 256), 1, 16)
