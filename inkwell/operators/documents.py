"""Other kinds of documents: plain text, Markdown with front matter, JSON, feeds and XML, page texts, byte parts."""

from __future__ import annotations

import json
import math
import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinds as K
from ..functions import markup as M
from ..functions.regex import Rx, let, trim_text
from ..functions.rowwise import by_row
from .scans import after_delays

#: How much of a JSON document is shown.
KEYS, SAMPLES, STRING, DEPTH, SHOWN, LARGE = 20, 3, 200, 5, 5000, 100_000
VALUE_DEPTH, VALUE_STRING, VALUE_ITEMS, VALUE_KEYS = 3, 100, 3, 5
#: Entries of a feed, and depth, children and text of other XML that are shown.
ENTRIES, XML_DEPTH, XML_CHILDREN, XML_TEXT, ENTRY_TEXT = 20, 4, 10, 50, 500


# --- plain text -------------------------------------------------------------------


def text_markdown(text: Column) -> Column:
    """A plain text as Markdown: underlined and capital lines are headings, bullets and numbers items; code is fenced."""
    lines = F.split(text, "\n")
    made = let(F.struct(lines.alias("lines"), F.transform(lines, M.trim).alias("bare")), _rewritten)
    return F.when(M.looks_like_code(text), F.concat(F.lit("```\n"), text, F.lit("\n```"))).otherwise(made)


def _rewritten(x: Column) -> Column:
    rule = r"^(=+|---+)\z"

    def at(i: Column) -> Column:
        return F.coalesce(F.get(x["bare"], i), F.lit(""))

    def rewrite(line: Column, i: Column) -> Column:
        b, after = at(i), at(i + 1)
        used = (i > 0) & (at(i - 1) != "") & ~at(i - 1).rlike(rule) & b.rlike(rule)
        bullet, number = rf"^(\s*)[{M.BULLETS}]\s+(.*)\z", r"^(\s*)(\d+)[.)]\s+(.*)\z"

        def indent(rx: str) -> Column:
            return F.when(F.regexp_extract(line, rx, 1) != "", "  ").otherwise("")

        return (
            F.when(used, F.lit(None).cast("string"))
            .when((b != "") & after.rlike(r"^=+\z"), F.concat(F.lit("# "), b))
            .when((b != "") & after.rlike(r"^---+\z"), F.concat(F.lit("## "), b))
            .when(M.capitals(line) & ~b.rlike(r"^[-*]"), F.concat(F.lit("## "), M.title_case(b)))
            .when(line.rlike(bullet), F.concat(indent(bullet), F.lit("- "), F.regexp_extract(line, bullet, 2)))
            .when(line.rlike(number), F.concat(indent(number), F.regexp_extract(line, number, 2), F.lit(". "), F.regexp_extract(line, number, 3)))
            .otherwise(line)
        )

    return F.array_join(F.filter(F.transform(x["lines"], rewrite), lambda line: line.isNotNull()), "\n")


# --- Markdown ---------------------------------------------------------------------

_FRONT = re.compile(r"^---\r?\n(.*?)\r?\n---\r?\n?", re.S)


def front_matter(text: str) -> tuple[dict, str, str | None]:
    """(fields, body, error): YAML between two rules at the start; a text whose YAML can't be read stays whole."""
    if not (m := _FRONT.match(text)):
        return {}, text, None
    try:
        import yaml

        fields = yaml.safe_load(m[1])
    except Exception as e:  # any YAML error is the document's
        return {}, text, f"Failed to parse frontmatter: {str(e).splitlines()[0]}"
    return (fields if isinstance(fields, dict) else {}), text[m.end() :], None


@by_row(K.struct(title=K.STRING, author=K.STRING, date=K.STRING, body=K.STRING, error=K.STRING))
def front_matter_column(text: str | None) -> tuple:
    fields, body, error = front_matter(text or "")
    return (*(None if fields.get(k) is None else str(fields[k]) for k in ("title", "author", "date")), body, error)


# --- JSON ---------------------------------------------------------------------------


def _dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def json_schema(x, depth: int = 0) -> dict:
    """The shape of a value: five levels, twenty keys, the first item's shape for all, three samples."""
    if depth > DEPTH:
        return {"type": "unknown", "truncated": True}
    if x is None:
        return {"type": "null"}
    if isinstance(x, str):
        return {"type": "string", "sample": x if len(x) <= STRING else x[:STRING] + "..."}
    if isinstance(x, bool | int | float):
        return {"type": "boolean" if isinstance(x, bool) else "number", "sample": x}
    if isinstance(x, list):
        shape: dict = {"type": "array", "count": len(x)}
        if x:
            shape |= {"items": json_schema(x[0], depth + 1), "sample": [json_sample(v, depth + 1) for v in x[:SAMPLES]]}
        return shape | ({"truncated": True} if len(x) > SAMPLES else {})
    shape = {"type": "object", "properties": {k: json_schema(x[k], depth + 1) for k in list(x)[:KEYS]}}
    return shape | ({"truncated": True, "count": len(x)} if len(x) > KEYS else {})


def json_sample(x, depth: int = 0):
    """A value in short: three levels, few items and keys, the number of those left out."""
    if depth > VALUE_DEPTH:
        return "{...}" if isinstance(x, dict | list) or x is None else x
    if isinstance(x, str):
        return x if len(x) <= VALUE_STRING else x[:VALUE_STRING] + "..."
    if isinstance(x, list):
        head = x if len(x) <= VALUE_ITEMS else x[:2]
        return [json_sample(v, depth + 1) for v in head] + ([f"... ({len(x) - 2} more)"] if len(x) > VALUE_ITEMS else [])
    if isinstance(x, dict):
        few = len(x) <= VALUE_KEYS
        out = {k: json_sample(x[k], depth + 1) for k in (list(x) if few else list(x)[:3])}
        return out if few else out | {"...": f"({len(x) - 3} more keys)"}
    return x


def _type_text(s: dict) -> str:
    if "properties" in s:
        keys = list(s["properties"])
        return f"{{ {', '.join(keys[:3])}{', ...' if len(keys) > 3 else ''} }}"
    if s["type"] == "array":
        return f"Array[{s['count']}]"
    if "sample" in s and len(shown := _dump(s["sample"])) < 50:
        return f"{s['type']} (e.g., {shown})"
    return s["type"]


def json_markdown(x, url: str | None = None) -> str:
    """The structure and a sample of a JSON value."""
    s = json_schema(x)
    if "properties" in s:
        rows = ["Object {", *(f'  "{k}": {_type_text(v)}' for k, v in s["properties"].items())]
        shape = "\n".join([*rows, *([f"  ... ({s['count']} total keys)"] if s.get("truncated") else []), "}"])
    elif s["type"] == "array":
        shape = f"Array[{s['count']}] of {_type_text(s.get('items', {'type': 'unknown'}))}" + (f"\n  (showing first {SAMPLES} items)" if s.get("truncated") else "")
    else:
        shape = _type_text(s)
    body = json.dumps(json_sample(x), ensure_ascii=False, indent=2)
    body = body if len(body) <= SHOWN else body[:SHOWN] + "\n\n... (truncated)"
    source = [f"Source: {url}\n"] if url else []
    return "\n".join(["# JSON Data\n", *source, "## Structure\n", shape, "\n## Sample Data\n", "```json", body, "```"])


def json_text(x) -> str:
    s = json_schema(x)
    if "properties" in s:
        keys = list(s["properties"])
        line = f"- Object with {len(keys)}{'+' if s.get('truncated') else ''} properties: {', '.join(keys[:10])}{'...' if len(keys) > 10 else ''}"
    elif s["type"] == "array":
        line = f"- Array with {s['count']} items" + (f"\n- Item type: {_type_text(s['items'])}" if "items" in s else "")
    else:
        line = f"- Type: {s['type']}"
    return f"JSON Data Structure:\n{line}"


# --- feeds and other XML ----------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _child(node, *names: str) -> str | None:
    for name in names:
        for c in node:
            if _local(c.tag) == name and (text := trim_text("".join(c.itertext()))):
                return text
    return None


def _link(node) -> str | None:
    links = [c for c in node if _local(c.tag) == "link"]
    best = [c for c in links if c.get("rel") in (None, "", "alternate")] or links
    return (best[0].get("href") or trim_text(best[0].text or "") or None) if best else None


def strip_html(text: str | None) -> str | None:
    if not text:
        return None
    text = re.sub("<[^>]+>", "", text)
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = text.replace(a, b)
    text = re.sub(r"&#(\d+);", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"&#[xX]([0-9a-fA-F]+);", lambda m: chr(int(m[1], 16) % 65536), text)
    return trim_text(Rx(r"\s+").py.sub(" ", text))


def read_feed(xml: str) -> dict | None:
    """Kind, head and the first entries of an RSS or Atom feed; None for other XML."""
    root = ET.fromstring(xml.strip().encode("utf-8", "replace"))
    kind = {"rss": "RSS", "feed": "Atom"}.get(_local(root.tag))
    if not kind:
        return None
    rss = kind == "RSS"
    head = next((c for c in root if _local(c.tag) == "channel"), root) if rss else root
    entries = [c for c in head if _local(c.tag) == ("item" if rss else "entry")]

    def entry(e) -> dict:
        author = next((c for c in e if _local(c.tag) == "author"), None)
        return dict(
            title=_child(e, "title") or "Untitled", link=(_child(e, "link") if rss else _link(e)) or "",
            description=strip_html(_child(e, "description") if rss else _child(e, "summary", "content")),
            published=_child(e, "pubDate") if rss else _child(e, "published", "updated"),
            author=_child(e, "author", "creator") if rss else (None if author is None else _child(author, "name", "email")),
            guid=_child(e, "guid") if rss else _child(e, "id"),
        )

    return dict(
        kind=kind, title=_child(head, "title") or f"{kind} Feed", description=_child(head, "description") if rss else _child(head, "subtitle"),
        link=_child(head, "link") if rss else _link(head), language=_child(head, "language") if rss else root.get("{http://www.w3.org/XML/1998/namespace}lang"),
        updated=_child(head, "lastBuildDate") if rss else _child(head, "updated"), count=len(entries), items=[entry(e) for e in entries[:ENTRIES]],
    )


def feed_markdown(feed: dict) -> str:
    out = [f"# {feed['title']}\n"] + ([f"{feed['description']}\n"] if feed["description"] else [])
    out += ["## Feed Info\n", f"- **Type:** {feed['kind']}", f"- **Items:** {feed['count']}"]
    out += [f"- **{name}:** {feed[k]}" for name, k in (("Link", "link"), ("Updated", "updated")) if feed[k]] + [""]
    if feed["items"]:
        out.append("## Recent Items\n")
    for i in feed["items"]:
        out.append(f"### {i['title']}\n")
        out += [f"[Read more]({i['link']})\n"] if i["link"] else []
        out += [f"*{name}: {i[k]}*" for name, k in (("Published", "published"), ("By", "author")) if i[k]]
        if text := i["description"]:
            out += ["\n" + text[:ENTRY_TEXT]] + (["..."] if len(text) > ENTRY_TEXT else [])
        out.append("")
    return "\n".join(out)


def xml_outline(node, depth: int = 0) -> str:
    """Elements of a few levels: repeated ones as a number of items, texts cut."""
    if depth > XML_DEPTH:
        return "..."
    groups: dict[str, list] = {}
    for c in node:
        groups.setdefault(_local(c.tag), []).append(c)
    pad, out = "  " * depth, []
    for name, found in list(groups.items())[:XML_CHILDREN]:
        if len(found) > 1:
            out.append(f"{pad}<{name}>[{len(found)} items]</{name}>")
        elif len(found[0]):
            out += [f"{pad}<{name}>", xml_outline(found[0], depth + 1), f"{pad}</{name}>"]
        else:
            text = trim_text(found[0].text or "")
            out.append(f"{pad}<{name}>{text[:XML_TEXT]}{'...' if len(text) > XML_TEXT else ''}</{name}>")
    if len(groups) > XML_CHILDREN:
        out.append(f"{pad}... ({len(groups) - XML_CHILDREN} more elements)")
    return "\n".join(out)


def xml_markdown(xml: str, url: str | None = None) -> tuple[str, str]:
    """(title, Markdown) of XML that is no feed."""
    root = ET.fromstring(xml.strip().encode("utf-8", "replace"))
    name = _local(root.tag)
    wrap = ET.Element("_")
    wrap.append(root)
    source = [f"Source: {url}\n"] if url else []
    text = "\n".join(["# XML Document\n", f"Root element: `<{name}>`\n", *source, "## Structure\n", "```xml", xml_outline(wrap), "```"])
    return f"XML Document ({name})", text


FEED = K.structs(title=K.STRING, link=K.STRING, description=K.STRING, published=K.STRING, author=K.STRING, guid=K.STRING)


@by_row(FEED)
def feed_items(xml: str | None) -> list[dict]:
    """Entries of a feed; none for what is no feed."""
    try:
        return (read_feed(xml) or {"items": []})["items"] if xml else []
    except ET.ParseError:
        return []


# --- structured documents, one column ---------------------------------------------------

STRUCTURED = K.struct(title=K.STRING, site_name=K.STRING, markdown=K.STRING, text=K.STRING, error=K.STRING, warnings=K.STRINGS)


def structured(text: str, kind: str, url: str | None) -> tuple:
    """(title, site_name, markdown, text, error, warnings) of JSON or XML."""
    try:
        if kind == "json":
            x = json.loads(text)
            notes = [f"Large JSON payload ({math.floor(len(text) / 1024 + 0.5)}KB) - content has been summarized"] if len(text) > LARGE else []
            return "JSON Data", None, json_markdown(x, url), json_text(x), None, notes
        if feed := read_feed(text):
            what = "items" if feed["kind"] == "RSS" else "entries"
            notes = [f"Showing {ENTRIES} of {feed['count']} {what}"] if feed["count"] > ENTRIES else []
            return feed["title"], feed["title"], feed_markdown(feed), feed["title"], None, notes
        title, body = xml_markdown(text, url)
        return title, None, body, body, None, []
    except (ValueError, ET.ParseError) as e:
        return None, None, None, None, str(e) or "Failed to parse", []


@by_row(STRUCTURED)
def structured_column(text: str | None, kind: str | None, url: str | None) -> tuple:
    return structured(text, kind, url) if isinstance(text, str) else (None,) * 5 + ([],)


# --- page texts (of a reader for PDF, say) -------------------------------------------------


def pages_markdown(pages: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """One row for each ``doc`` of ``pages(doc, page_no, text)``: what a packet of it needs.

    ``markdown`` has the title, author, day and number of pages that
    ``info(doc, title, author, created)`` knows, and a section for each page with
    text; ``text`` is that of all pages, ``excerpt`` its beginning. Pages with
    little text on average, or mostly empty ones, are doubtful
    (``low_confidence``, with a warning): they may be scans. A null text is empty;
    a document with a null ``doc`` is one of its own.
    """
    bare = F.trim(F.coalesce("text", F.lit("")))
    per = pages.groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("page_no", bare.alias("text")))).alias("_pages"), F.count("*").alias("page_count"),
        F.avg(F.length(bare)).alias("_mean"), F.count_if(bare == "").alias("empty_pages"),
    )
    if info is None:
        per = per.withColumns({c: F.lit(None).cast("string") for c in ("title", "author", "created")})
    else:
        known = info.groupBy(F.col("doc").alias("_doc")).agg(*[F.first(c, ignorenulls=True).cast("string").alias(c) for c in ("title", "author", "created")])
        per = per.join(known, F.col("doc").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    made = pdf_date(F.col("created"))
    filled = F.filter("_pages", lambda p: p["text"] != "")
    sections = F.transform(filled, lambda p: F.concat(F.lit("## Page "), p["page_no"].cast("string"), F.lit("\n\n"), p["text"], F.lit("\n")))
    about = F.array_join(F.array_compact(F.array(
        F.concat(F.lit("- **Author:** "), F.nullif("author", F.lit(""))), F.concat(F.lit("- **Created:** "), F.date_format(made, "yyyy-MM-dd")),
        F.concat(F.lit("- **Pages:** "), F.col("page_count").cast("string")),
    )), "\n")
    title = F.nullif("title", F.lit(""))
    parts = F.concat(F.array_compact(F.array(F.concat(F.lit("# "), title, F.lit("\n")), F.concat(about, F.lit("\n")))), sections)
    doubtful = (F.col("_mean") < 100) | (F.col("empty_pages") / F.col("page_count") > 0.5)
    warning = F.concat(
        F.lit("Low text extraction confidence - PDF may be scanned images. Average "), F.floor(F.col("_mean") + 0.5).cast("string"), F.lit(" chars/page, "),
        F.col("empty_pages").cast("string"), F.lit("/"), F.col("page_count").cast("string"), F.lit(" empty pages."),
    )
    text = F.trim(F.array_join(F.transform("_pages", lambda p: p["text"]), "\n\n"))
    return per.select(
        "doc", F.coalesce(title, F.concat(F.lit("PDF Document ("), F.col("page_count").cast("string"), F.lit(" pages)"))).alias("title"), F.col("author").alias("author"), made.alias("created_at"),
        M.trim(F.array_join(parts, "\n")).alias("markdown"), M.trim(text).alias("text"), F.substring(M.trim(text), 1, 300).alias("excerpt"), "page_count", "empty_pages",
        doubtful.alias("low_confidence"), F.when(doubtful, warning).alias("warning"),
    )


def pdf_date(text: Column) -> Column:
    """``D:YYYYMMDDHHmmss`` as a timestamp; what is missing is the earliest, the offset is ignored."""
    digits = F.regexp_extract(text, r"^(?:D:)?(\d{4,14})", 1)
    return F.when(digits != "", F.try_to_timestamp(F.concat(digits, F.substring(F.lit("00000101000000"), F.length(digits) + 1, F.lit(14))), F.lit("yyyyMMddHHmmss")))


# --- parts of a number of bytes ---------------------------------------------------------------


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def _joined(parts: list[str], glue: str, most: int, deeper) -> list[str]:
    """Parts put together while they fit; one that doesn't fit by itself is replaced by what ``deeper`` makes of it."""
    out, held = [], ""
    for part in parts:
        if _bytes(both := held + glue + part if held else part) <= most:
            held = both
            continue
        out += [held] if held else []
        held = ""
        if _bytes(part) <= most:
            held = part
        else:
            done, held = deeper(part)
            out += done
    return out + ([held] if held else [])


def _characters(line: str, most: int) -> list[str]:
    return _joined(list(line), "", most, lambda c: ([c], ""))


def _lines(paragraph: str, most: int) -> list[str]:
    return _joined(paragraph.split("\n"), "\n", most, lambda line: (_characters(line, most), ""))


def split_bytes(text: str, most: int) -> list[str]:
    """Parts of at most so many bytes, cut between paragraphs, else lines, else characters; 0 or less cuts nothing."""
    if most <= 0 or _bytes(text) <= most:
        return [text]

    def deeper(paragraph: str) -> tuple[list[str], str]:
        packed = _joined(_lines(paragraph, most), "\n", most, lambda c: ([c], ""))
        return packed[:-1], packed[-1] if packed else ""

    return _joined(re.split(r"\n{2,}", text), "\n\n", most, deeper)


def split_bytes_column(text: Column, most: int) -> Column:
    @by_row(K.STRINGS)
    def run(whole: str | None) -> list[str] | None:
        return split_bytes(whole, most) if isinstance(whole, str) else None

    return run(text)


def front(packet: dict, part: int, parts: int) -> str:
    """The head of a stored part: where it comes from, and which part of how many it is."""
    q = lambda x: json.dumps(x, ensure_ascii=False)
    rows = ["---", f"source_url: {q(packet['canonical_url'])}", f"original_url: {q(packet['original_url'])}", f"retrieved_at: {q(packet['retrieved_at'])}"]
    rows += [f"content_hash: {packet['content_hash']}", f"source_id: {packet['source_id']}", f"content_type: {q(packet['content_type'])}"]
    rows += [f"{k}: {q(packet[k])}" for k in ("title", "author", "published_at") if packet.get(k)]
    return "\n".join([*rows, f"part: {part}", f"parts: {parts}", "---"])


def stored_parts(packet: dict, most: int, rounds: int = 3) -> list[str]:
    """A packet's parts with their heads, each within the bytes; the heads' size depends on the number of parts."""
    count = 1
    for _ in range(rounds):
        room = most - _bytes(front(packet, count, count)) - 2
        if most > 0 and room <= 0:
            raise ValueError("the head alone is larger than a part may be")
        pieces = split_bytes(packet["content"], room if most > 0 else 0)
        if len(pieces) == count:
            break
        count = len(pieces)
    return [f"{front(packet, i + 1, len(pieces))}\n\n{p}" for i, p in enumerate(pieces)]


def part_key(base: Column, hash_: Column, index: Column) -> Column:
    return F.concat(base, F.lit("/"), hash_, F.lit("/part-"), F.lpad(index.cast("string"), 4, "0"), F.lit(".md"))


def crawl_schedule(requests: DataFrame, host: str = "host", at: str = "at", delay: str = "delay", ties: tuple[str, ...] = ()) -> DataFrame:
    """``requests`` with ``start``: no sooner than asked, and a delay after the host's last one.

    Requests of the same time are taken in order of ``ties``. Numbers of any
    unit; microseconds are cut into hours, so no host meets in one task
    (:func:`..operators.scans.after_delays`).
    """
    return after_delays(requests, host, at, delay, ties)
