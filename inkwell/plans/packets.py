"""Raw pages to packets: one wide row a page, every failure a verdict in its row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kinds as K
from ..functions import markup as M
from ..functions import urls as U
from ..functions.injection import detections
from ..functions.regex import settled
from ..functions.rowwise import AT_ONCE
from ..functions.tokens import reading_minutes
from ..operators import documents as D
from ..operators import gates, html
from ..operators.markdown import blocks, headings_column, outline

#: Bytes of a body at most, characters of a raw excerpt.
MAX_BYTES, RAW_EXCERPT = 10_485_760, 1000
_STRINGS = "array<string>"


def fetch_error(status: Column, body: Column, max_bytes: int = MAX_BYTES) -> Column:
    """An error code for what was served, or null: bad status, then a body over the limit (never a part of it)."""
    return F.when((status < 200) | (status >= 300), F.concat(F.lit("HTTP_"), status.cast("string"))).when(F.octet_length(body) > max_bytes, "CONTENT_TOO_LARGE")


def retryable(status: Column) -> Column:
    return (status == 429) | (status >= 500)


def backoff_seconds(errors: Column, retry_after: Column) -> Column:
    """How long a host rests: what it asks for, else 2^n seconds for n errors up to 6; five minutes at most."""
    return F.least(F.lit(300.0), F.coalesce(retry_after.try_cast("double"), F.pow(F.lit(2.0), F.least(errors, F.lit(6)))))


def cache_key(url: Column, agent: Column, headers: Column, max_bytes: Column, redirects: Column) -> Column:
    pairs = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(F.lower(e["key"]), F.lit(":"), e["value"])))
    return F.concat_ws("::", U.canonical(url), agent, F.array_join(pairs, "|"), max_bytes.cast("string"), redirects.cast("string"))


def extracted(pages: DataFrame, remove: Sequence[str] = (), tables: bool = True, code: bool = True, books: DataFrame | None = None) -> DataFrame:
    """``pages(body, content_type, final_url)`` with ``ctype``, ``text`` and ``doc``: title, Markdown, metadata, warnings, error.

    Python sees only the rows whose kind needs it: trees for HTML, parsers for
    JSON, XML and front matter; text and Markdown stay expressions. ``books``,
    as :func:`..operators.documents.pages_markdown` makes them of the pages that
    a reader of PDF gives, hold the texts of PDF files by their final URL.
    """
    rows = pages.withColumn("ctype", settled(M.content_type(F.coalesce("content_type", F.lit("")), F.col("body"))))
    rows = rows.withColumn("text", settled(M.decode_body(F.col("body"), F.col("ctype.charset"))))
    kind = F.col("ctype.type")
    rows = rows.withColumn("_html", html.extract_column(F.when(kind == "html", F.col("text")), tuple(remove), tables, code))
    rows = rows.withColumn("_data", D.structured_column(F.when(kind.isin("json", "xml"), F.col("text")), kind, F.col("final_url")))
    rows = rows.withColumn("_front", D.front_matter_column(F.when(kind == "markdown", F.col("text"))))
    rows = rows.withColumn("_safe", settled(M.safe_markdown(F.col("_front.body"))))
    rows = rows.withColumn("_heads", headings_column(F.when(kind == "markdown", F.col("_safe.markdown"))))
    if books is not None:
        read = books.where("doc is not null").dropDuplicates(["doc"]).select(F.col("doc").cast("string").alias("_doc"), F.struct("title", "author", "created_at", "markdown", "warning").alias("_pdf"))
        rows = rows.join(read, (F.col("ctype.type") == "pdf") & (F.col("final_url") == F.col("_doc")), "left").drop("_doc")
    plain = M.normal_lines(F.col("text"))
    none, empty = F.lit(None).cast("string"), F.array().cast(_STRINGS)

    def doc(markdown, title=none, site=none, author=none, published=none, language=none, warnings=empty, paywalled=F.lit(False), error=none) -> Column:
        return F.struct(
            markdown.alias("markdown"), title.alias("title"), site.alias("site_name"), author.alias("author"), published.alias("published_at"),
            language.alias("language"), warnings.alias("warnings"), paywalled.alias("paywalled"), error.alias("error"),
        )

    removed = F.array_compact(F.array(F.col("_front.error"), *[
        F.when(F.col(f"_safe.{n}s") > 0, F.concat(F.lit("Removed "), F.col(f"_safe.{n}s").cast("string"), F.lit(f" {label} from markdown")))
        for n, label in (("script", "script tag(s)"), ("style", "style tag(s)"), ("iframe", "iframe(s)"))
    ]))
    h, s = "_html", "_data"
    made = (
        F.when(kind == "html", doc(F.col(f"{h}.markdown"), F.col(f"{h}.title"), F.col(f"{h}.site_name"), F.col(f"{h}.author"), F.col(f"{h}.published_at"), F.col(f"{h}.language"), F.col(f"{h}.warnings"), F.col(f"{h}.paywalled")))
        .when(kind.isin("json", "xml"), doc(F.col(f"{s}.markdown"), F.col(f"{s}.title"), F.col(f"{s}.site_name"), warnings=F.coalesce(f"{s}.warnings", empty), error=F.col(f"{s}.error")))
        .when(kind == "markdown", doc(F.col("_safe.markdown"), F.coalesce("_front.title", F.get("_heads", F.lit(0))["text"]), author=F.col("_front.author"), published=F.col("_front.date"), warnings=removed))
        .when(kind == "pdf", doc(none, error=F.lit("PDF extraction is disabled")) if books is None else doc(
            F.col("_pdf.markdown"), F.col("_pdf.title"), author=F.col("_pdf.author"), published=F.date_format("_pdf.created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
            warnings=F.array_compact(F.array("_pdf.warning")), error=F.when(F.col("_pdf").isNull(), "No pages of this PDF were given")))
        .otherwise(doc(D.text_markdown(plain), M.text_title(plain)))
    )
    return rows.withColumn("doc", settled(made)).drop("_html", "_data", "_front", "_safe", "_heads", "_pdf")


def normalize(
    pages: DataFrame, remove: Sequence[str] = (), tables: bool = True, code: bool = True, raw_excerpt: bool = False, books: DataFrame | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Packets of ``pages(original_url, final_url, status, content_type, body, retrieved_at)``.

    A page without Markdown fails: ``success`` is false and ``error`` says why.
    ``retrieved_at`` is data, so a rerun gives the same ids. ``keep`` names
    columns of the pages that stay. No shuffle, unless ``books`` are joined.
    """
    rows = extracted(pages, remove, tables, code, books)
    ok = F.coalesce(F.col("doc.markdown") != "", F.lit(False))
    failed = F.coalesce("doc.error", F.concat(F.initcap("ctype.type"), F.lit(" extraction failed")))
    rows = _with_structure(rows.select(
        "original_url", "final_url", "retrieved_at", "status", F.col("ctype.mime_type").alias("mime"), M.encoding(F.col("ctype.charset"))["note"].alias("note"), "doc",
        ok.alias("ok"), F.when(~ok, failed).alias("failed"), F.sha2("body", 256).alias("raw_hash"), F.substring("text", 1, RAW_EXCERPT).alias("excerpt"),
        F.when(ok, F.col("doc.markdown")).alias("markdown"), *keep,
    ))
    rows = rows.withColumn("unsafe", settled(detections(F.col("markdown"))))

    def warning(kind: str, message: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), message.alias("message"))

    notes = F.array_compact(F.array(
        F.when(F.col("note").isNotNull(), warning("extraction_fallback", F.col("note"))),
        F.when(F.col("doc.paywalled"), warning("paywalled", F.lit("Content appears to be paywalled"))),
    ))
    found = F.when(F.size("unsafe") > 0, F.array(warning("injection_detected", F.concat(F.lit("Detected "), F.size("unsafe").cast("string"), F.lit(" potential prompt injection pattern(s)")))))
    none = F.array().cast("array<struct<type:string,message:string>>")
    warnings = F.concat(notes, F.transform("doc.warnings", lambda w: warning("extraction_fallback", w)), F.coalesce(found, none))
    hash_ = M.content_hash(F.col("markdown"))
    url = U.canonical(F.col("final_url"))

    def known(c: str) -> Column:
        return F.when(F.col(c) != "", F.col(c))

    meta = F.struct(
        known("doc.title").alias("title"), known("doc.site_name").alias("site_name"), known("doc.author").alias("author"), known("doc.published_at").alias("published_at"),
        known("doc.language").alias("language"), reading_minutes(F.col("markdown")).alias("estimated_reading_time_min"),
    )
    columns = [
        F.col("ok").alias("success"), F.col("failed").alias("error"), M.source_id(url, F.col("retrieved_at"), hash_).alias("source_id"), F.col("original_url"), url.alias("canonical_url"),
        F.date_format("retrieved_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("retrieved_at"), F.col("status"), F.col("mime").alias("content_type"), meta.alias("metadata"),
        F.col("outline"), F.col("key_blocks"), F.col("markdown").alias("content"), M.source_summary(F.col("markdown"), F.col("outline")).alias("source_summary"),
        F.array().cast("array<struct<block_id:string,start_char:int,end_char:int>>").alias("citations"), F.col("unsafe").alias("unsafe_instructions_detected"), warnings.alias("warnings"),
        F.struct(hash_.alias("content_hash"), F.col("raw_hash")).alias("hashes"),
    ]
    if raw_excerpt:
        columns.append(F.col("excerpt").alias("raw_excerpt"))
    return rows.select(*columns, *keep)


_OUTLINE = pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string()), ("path", pa.string())]))
_BLOCKS = pa.list_(pa.struct([("block_id", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("char_len", pa.int32())]))


def _with_structure(rows: DataFrame) -> DataFrame:
    """``rows`` with ``outline`` and ``key_blocks`` of ``markdown``: one walk over the lines in Python, and a place where plans end.

    Everything before is computed once; as expressions, the choice among kinds
    of documents would be repeated in each later column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("markdown")).to_pylist()]
            heads = pa.array([[dict(level=a, text=b, path=c) for a, b, c, _ in outline(t)] for t in texts], _OUTLINE)
            parts = pa.array([[dict(zip(("block_id", "kind", "text", "char_len"), b, strict=True)) for b in blocks(t)] for t in texts], _BLOCKS)
            yield pa.RecordBatch.from_arrays([*batch.columns, heads, parts], [*batch.schema.names, "outline", "key_blocks"])

    schema = T.StructType([*rows.schema.fields, T.StructField("outline", K.OUTLINE), T.StructField("key_blocks", K.BLOCKS)])
    return rows.mapInArrow(run, schema)


def normalized_view(packets: DataFrame) -> DataFrame:
    """Packets without their hashes."""
    return packets.drop("hashes")


def fetch(pages: DataFrame, rules: DataFrame | None = None, dns: DataFrame | None = None, max_bytes: int = MAX_BYTES, allow: tuple[str, ...] = (), books: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Gates, then packets: ``pages`` as for :func:`normalize`; ``error_code`` is set where a gate or the server said no.

    All pages stay in the result. Gates are cheap and come first, so only pages
    that pass are read by parsers.
    """
    rows = gates.url_verdict(pages, dns, "final_url", allow=allow)
    code = F.when(F.col("error") == "Invalid URL", "INVALID_URL").when(F.col("error") == "Protocol not allowed", "INVALID_PROTOCOL").when(~F.col("safe"), "SSRF_BLOCKED")
    if rules is not None:
        rows = gates.robots_verdict(rows, rules, "final_url")
        code = code.when(~F.col("allowed"), "ROBOTS_BLOCKED")
    code = F.coalesce(code, fetch_error(F.col("status"), F.col("body"), max_bytes))
    rows = rows.withColumn("error_code", code).withColumnRenamed("error", "gate_error")
    stopped = F.col("error_code").isNotNull()
    # parsers see no body of a page that was stopped; all pages take one way, so gates and joins run once
    done = normalize(rows.withColumn("body", F.when(~stopped, F.col("body"))), books=books, keep=("error_code", "gate_error", *keep))
    told = {
        "success": F.when(stopped, False).otherwise(F.col("success")), "error": F.when(stopped, F.coalesce("gate_error", "error_code")).otherwise(F.col("error")),
        "error_code": F.coalesce("error_code", F.when(~F.col("success"), "EXTRACTION_FAILED")),
    }
    same = ("original_url", "status", *keep)
    return done.select(*[told[c].alias(c) if c in told else F.col(c) if c in same else F.when(~stopped, F.col(c)).alias(c) for c in done.columns if c != "gate_error"])


MODES = ("auto", "http", "render")


def fetch_rendered(pages: DataFrame, rendered: DataFrame, mode: str = "auto", **options) -> DataFrame:
    """As :func:`fetch`, with the pages that a browser made of some URLs: ``rendered`` has the columns of ``pages``, and ``screenshot`` if it took any.

    ``render`` takes only these. ``auto`` takes one first for hosts that need a
    browser, and then where a page that was served gives no packet or one that is
    thin for its size; where there is none, or it gives no packet, the served one
    counts. ``used_render`` tells which it was, ``screenshot_base64`` is that of
    the page taken. A URL is expected once in each; of several rendered pages one counts.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")
    shot = F.col("screenshot") if "screenshot" in rendered.columns else F.lit(None).cast("binary")
    made = rendered.withColumn("screenshot", shot)
    if mode == "render":
        only = fetch(made, keep=("screenshot",), **options)
        return only.withColumn("used_render", F.lit(True)).withColumn("screenshot_base64", F.base64("screenshot")).drop("screenshot")
    served = fetch(pages.withColumn("_size", F.octet_length("body")), keep=("_size",), **options)
    if mode == "http":
        return served.withColumn("used_render", F.lit(False)).withColumn("screenshot_base64", F.lit(None).cast("string")).drop("_size")
    thin = F.col("success") & gates.render_fallback(F.coalesce("content_type", F.lit("")), F.col("_size"), F.coalesce("content", F.lit("")), F.size("outline"))
    wanted = gates.needs_browser(F.col("original_url")) | F.coalesce(F.col("error_code") == "EXTRACTION_FAILED", F.lit(False)) | F.coalesce(thin, F.lit(False))
    columns = [c for c in served.columns if c != "_size"]
    served = served.select(F.struct(*columns).alias("_old"), wanted.alias("_wanted"), F.col("original_url").alias("_asked"))
    both = served.join(made.dropDuplicates(["original_url"]), F.col("_asked") == F.col("original_url"), "left")
    # one way for all rows again: parsers see only the rendered pages that are wanted
    both = both.withColumn("_wanted", F.col("_wanted") & F.col("original_url").isNotNull()).withColumn("body", F.when(F.col("_wanted"), F.col("body")))
    again = fetch(both, keep=("_old", "_wanted", "screenshot"), **options)
    used = F.col("_wanted") & F.col("success")
    return again.select(*[F.when(used, F.col(c)).otherwise(F.col(f"_old.{c}")).alias(c) for c in columns], used.alias("used_render"), F.when(used, F.base64("screenshot")).alias("screenshot_base64"))


def extract(inputs: DataFrame, fetched: DataFrame | None = None, **options) -> DataFrame:
    """Packets of ``inputs(url, raw_bytes, content_type, canonical_url, retrieved_at)``: of a URL the one that was ``fetched``, else of the bytes.

    Rows with neither are errors (``INVALID_INPUT``), as are URLs that weren't
    fetched (``NOT_FETCHED``) and bytes that give no packet (``EXTRACTION_FAILED``).
    """
    url = F.coalesce("canonical_url", F.lit("unknown://source"))
    rows = inputs.select(
        F.col("url").alias("_url"), F.coalesce("url", url).alias("original_url"), url.alias("final_url"), F.lit(200).alias("status"), F.coalesce("content_type", F.lit("application/octet-stream")).alias("content_type"),
        F.when(F.col("url").isNull(), F.col("raw_bytes")).alias("body"), "retrieved_at", F.when(F.col("url").isNull() & F.col("raw_bytes").isNull(), "INVALID_INPUT").alias("error_code"),
    )
    made = normalize(rows, keep=("_url", "error_code"), **options)
    code = F.coalesce("error_code", F.when(F.col("_url").isNotNull(), "NOT_FETCHED").when(~F.col("success"), "EXTRACTION_FAILED"))
    own = made.withColumn("error_code", code).withColumn("error", F.when(code == "INVALID_INPUT", "Either url or raw_bytes must be provided").when(code == "NOT_FETCHED", "The URL was not fetched").otherwise(F.col("error")))
    columns = [c for c in own.columns if c != "_url"]
    if fetched is None:
        return own.select(columns)
    known = fetched.dropDuplicates(["original_url"]).select(F.col("original_url").alias("_at"), F.struct(*columns).alias("_found"))
    both = own.join(known, F.col("_url") == F.col("_at"), "left")
    return both.select(*[F.when(F.col("_found").isNotNull(), F.col(f"_found.{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def resources(packets: DataFrame, kind: str) -> DataFrame:
    """(source_id, uri, mime_type, text, size) of the packets as one kind of resource."""
    if kind not in U.RESOURCE_KINDS:
        raise ValueError(f"kind is one of {U.RESOURCE_KINDS}")
    shot = F.col("screenshot_base64") if "screenshot_base64" in packets.columns else F.lit(None).cast("string")
    whole = F.to_json(F.struct(*packets.columns))
    text = {"packet": whole, "content": F.col("content"), "normalized": F.to_json(F.struct(*normalized_view(packets).columns)), "screenshot": shot}[kind]
    mime = {"packet": "application/json", "content": "text/markdown", "normalized": "application/json", "screenshot": "image/png"}[kind]
    rows = packets.withColumn("text", text).where("text is not null and trim(text) <> ''")
    return rows.select("source_id", U.build_resource(F.lit(kind), F.col("source_id")).alias("uri"), F.lit(mime).alias("mime_type"), "text", F.octet_length("text").alias("size"))


def read_resources(packets: DataFrame, uris: DataFrame, uri: str = "uri", scheme: str = "inkwell") -> DataFrame:
    """Each of ``uris`` with ``mime_type`` and ``text`` of the packet's resource that it names, or an ``error``.

    An address that can't be read, one of a packet that isn't there, and a
    screenshot that a packet doesn't have are not found. Of packets with one id
    any counts. Repeated addresses each have a row.
    """
    shot = F.col("screenshot_base64") if "screenshot_base64" in packets.columns else F.lit(None).cast("string")
    kept = packets.where("source_id is not null").dropDuplicates(["source_id"]).select(
        F.col("source_id").alias("_id"), F.to_json(F.struct(*packets.columns)).alias("_packet"), F.coalesce("content", F.lit("")).alias("_content"),
        F.to_json(F.struct(*normalized_view(packets).columns)).alias("_normalized"), F.when(shot != "", shot).alias("_shot"),
    )
    asked = uris.select(uri, U.parse_resource(F.col(uri), scheme).alias("_asked"))
    rows = asked.join(kept, F.col("_asked.source_id") == F.col("_id"), "left")
    kind = F.col("_asked.kind")
    text = F.when(kind == "packet", F.col("_packet")).when(kind == "content", F.col("_content")).when(kind == "normalized", F.col("_normalized")).when(kind == "screenshot", F.col("_shot"))
    mime = F.when(kind == "content", "text/markdown").when(kind == "screenshot", "image/png").otherwise("application/json")
    return rows.select(uri, F.when(text.isNotNull(), mime).alias("mime_type"), text.alias("text"), F.when(text.isNull(), "Resource not found").alias("error"))
