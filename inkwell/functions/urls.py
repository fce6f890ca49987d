"""URLs: parts, canonical form, keys, and what they say about content."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kinds as K

#: Query parameters that only track.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_source_platform utm_creative_format utm_marketing_tactic "
    "fbclid gclid gclsrc dclid msclkid twclid li_fat_id mc_cid mc_eid _ga _gl ref ref_src source click_id affiliate_id partner_id"
).split()
#: Path endings and their types; hosts whose pages need a browser.
ENDINGS = (
    ((".md", ".markdown"), "text/markdown"), ((".txt",), "text/plain"), ((".pdf",), "application/pdf"), ((".json",), "application/json"),
    ((".xml",), "application/xml"), ((".rss",), "application/rss+xml"), ((".atom",), "application/atom+xml"), ((".html", ".htm"), "text/html"),
)
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def valid(url: Column) -> Column:
    """Scheme and host are there."""
    return F.coalesce((scheme(url) != "") & (_part(url, 2) != ""), F.lit(False))


def hostname(url: Column) -> Column:
    return F.when(valid(url), F.lower(_part(url, 2)))


def port(url: Column) -> Column:
    """The port, if it isn't the scheme's own."""
    p, s = _part(url, 3), scheme(url)
    return F.when(((s == "http") & (p == "80")) | ((s == "https") & (p == "443")), "").otherwise(p)


def path(url: Column) -> Column:
    return F.when(_part(url, 4) == "", "/").otherwise(_part(url, 4))


def origin(url: Column) -> Column:
    """``scheme://host[:port]``, null for what is no URL."""
    p = port(url)
    return F.when(valid(url), F.concat(scheme(url), F.lit("://"), hostname(url), F.when(p == "", "").otherwise(F.concat(F.lit(":"), p))))


def same_origin(a: Column, b: Column) -> Column:
    return F.coalesce(origin(a) == origin(b), F.lit(False))


def allowed_protocol(url: Column) -> Column:
    return valid(url) & scheme(url).isin("http", "https")


def canonical(url: Column) -> Column:
    """Tracking parameters gone, the others sorted by name, one slash fewer at the end, own ports gone; else unchanged.

    Parameters stay percent-encoded as they are written. The sort is stable.
    """
    pairs = F.filter(F.split(F.substring(_part(url, 5), 2, 1_000_000), "&"), lambda p: p != "")
    kept = F.filter(pairs, lambda p: ~F.lower(F.split(p, "=")[0]).isin(*TRACKING))
    ordered = F.transform(
        F.array_sort(F.transform(kept, lambda p, i: F.struct(F.split(p, "=")[0].alias("k"), i.alias("i"), p.alias("p")))),
        lambda s: F.when(F.contains(s["p"], F.lit("=")), s["p"]).otherwise(F.concat(s["p"], F.lit("="))),
    )
    query = F.array_join(ordered, "&")
    p = path(url)
    bare = F.when((F.length(p) > 1) & p.endswith("/"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)
    whole = F.concat(origin(url), bare, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), _part(url, 6))
    return F.when(valid(url), whole).otherwise(url)


def mime_of(url: Column) -> Column:
    """The content type that a path's ending names, or null."""
    p, out = F.lower(path(url)), F.lit(None).cast("string")
    for ends, kind in reversed(ENDINGS):
        hit = F.lit(False)
        for e in ends:
            hit = hit | p.endswith(e)
        out = F.when(hit, kind).otherwise(out)
    return F.when(valid(url), out)


@F.pandas_udf(K.STRING)
def resolve(base: pd.Series, relative: pd.Series) -> pd.Series:
    """A reference resolved against its page."""
    return pd.Series([urljoin(b, r) if b and r is not None else r for b, r in zip(base, relative, strict=True)])


def prefix(text: Column) -> Column:
    """An object prefix: no slashes in front, one at the end, or empty."""
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "^/+", "")
    return F.when((bare == "") | bare.endswith("/"), bare).otherwise(F.concat(bare, F.lit("/")))


def object_key(url: Column, under: Column | None = None) -> Column:
    """``[prefix/]host/path`` of safe characters; the root is ``root``."""
    bare = F.regexp_replace(path(url), "/$", "")
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(bare, r"\+", "%2B")), bare)
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(decoded, "^/+", ""), "[^A-Za-z0-9/_.-]", "_"), "/{2,}", "/")
    key = F.concat(hostname(url), F.lit("/"), F.when(safe == "", "root").otherwise(safe))
    return key if under is None else F.concat(prefix(under), key)


#: Kinds of resources that a packet offers.
RESOURCE_KINDS = ("packet", "content", "normalized", "screenshot")


def parse_resource(uri: Column, scheme_name: str = "inkwell") -> Column:
    """(kind, source_id) of ``scheme://kind/id``: a known kind, one segment, nothing else; null otherwise."""
    rx = rf"^{scheme_name}://({'|'.join(RESOURCE_KINDS)})/([^/?#]+)$"
    return F.when(uri.rlike(rx), F.struct(F.regexp_extract(uri, rx, 1).alias("kind"), F.try_url_decode(F.regexp_extract(uri, rx, 2)).alias("source_id")))


def build_resource(kind: Column, source_id: Column, scheme_name: str = "inkwell") -> Column:
    return F.concat(F.lit(f"{scheme_name}://"), kind, F.lit("/"), F.url_encode(source_id))
