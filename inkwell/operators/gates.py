"""Gates before a page is fetched: addresses, hosts, crawl rules. Bad rows get a verdict, never an exception."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.regex import Rx, trim

#: Blocked IPv4 ranges, first and last address.
IPV4_RANGES = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"),
    ("192.88.99.0", "192.88.99.255"), ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "239.255.255.255"), ("240.0.0.0", "255.255.255.254"), ("255.255.255.255", "255.255.255.255"),
)
#: Blocked IPv6 beginnings, as written; strict mode has whole networks for three of them.
IPV6_BEGINNINGS = ("::1", "::", "::ffff:", "fe80:", "fc00:", "fd00:", "ff00:", "2001:db8:", "100::", "64:ff9b::")
_STRICT = r"^(f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:)"
#: Hosts whose pages need a browser, and what marks a tracker and a content network in a request.
BROWSER_HOSTS = ("twitter.com", "x.com", "facebook.com", "instagram.com", "linkedin.com", "reddit.com", "medium.com", "substack.com")
TRACKERS = ("analytics", "tracking", "pixel", "beacon", "ads", "doubleclick", "googlesyndication", "facebook.net", "twitter.com/i/")
NETWORKS = ("cdn", "static", "assets")


def _number(ip: str) -> int:
    return sum(int(x) << (24 - 8 * i) for i, x in enumerate(ip.split(".")))


def ipv4_number(ip: Column) -> Column:
    """A dotted address as a long, null if it is none."""
    parts = F.split(ip, r"\.")
    octets = [F.try_element_at(parts, F.lit(i)).try_cast("int") for i in range(1, 5)]
    good = ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\z")
    for o in octets:
        good = good & (o <= 255)
    value = sum((o.cast("long") * (1 << (24 - 8 * i)) for i, o in enumerate(octets)), F.lit(0).cast("long"))
    return F.when(good, value)


def blocked_ipv4(ip: Column) -> Column:
    """In a blocked range, or no address at all."""
    n, hit = ipv4_number(ip), F.lit(False)
    for a, b in IPV4_RANGES:
        hit = hit | n.between(_number(a), _number(b))
    return F.coalesce(hit, F.lit(True))


def blocked_ipv6(ip: Column, strict: bool = True) -> Column:
    low, hit = F.lower(ip), F.lit(False)
    for p in IPV6_BEGINNINGS:
        hit = hit | low.startswith(p)
    return hit | low.rlike(_STRICT) if strict else hit


def blocked_ip(ip: Column, strict: bool = True) -> Column:
    return F.when(F.contains(ip, F.lit(":")), blocked_ipv6(ip, strict)).otherwise(blocked_ipv4(ip))


def ranges_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(_number(a), _number(b)) for a, b in IPV4_RANGES], "lo long, hi long")


def blocked_by_join(ips: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Rows whose address is blocked, by a range semi-join with the 16 fixed ranges, which are broadcast."""
    rows = ips.withColumn("_n", ipv4_number(F.col(ip_col)))
    known = rows.join(F.broadcast(ranges_table(ips)), F.col("_n").between(F.col("lo"), F.col("hi")), "left_semi")
    return known.unionByName(rows.where("_n is null")).drop("_n")


def is_literal(host: Column, strict: bool = True) -> Column:
    bare = F.regexp_replace(host, r"^\[|\]$", "") if strict else host
    return bare.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\z") | F.contains(bare, F.lit(":"))


def within(host: Column, domains: tuple[str, ...] | list[str]) -> Column:
    """The host is one of the domains or below one."""
    hit = F.lit(False)
    for d in domains:
        hit = hit | (host == d.lower()) | host.endswith("." + d.lower())
    return hit


def url_verdict(urls: DataFrame, dns: DataFrame | None = None, url_col: str = "url", block_private: bool = True, allow: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """``urls`` with ``safe`` and ``error``: protocol, allowed domains, then addresses.

    ``dns(host, address)`` says what names resolve to; a host is blocked if any
    of its addresses is, or if it has none. Without it only literal addresses
    and local names are judged.
    """
    host = U.hostname(F.col(url_col))
    rows = urls.withColumn("_host", host)
    bare = F.regexp_replace("_host", r"^\[|\]$", "")
    local = (F.col("_host") == "localhost") | F.col("_host").endswith(".localhost")
    literal = is_literal(F.col("_host"), strict)
    error = F.when(host.isNull(), "Invalid URL").when(~U.allowed_protocol(F.col(url_col)), "Protocol not allowed")
    if allow:
        error = error.when(~within(F.col("_host"), allow), "Domain not in allowlist")
    error = error.when(local, "Localhost is blocked")
    if block_private:
        error = error.when(literal & blocked_ip(bare, strict), "IP address is blocked")
    if dns is not None:
        known = dns.groupBy(F.lower("host").alias("_name")).agg(F.bool_or(blocked_ip(F.col("address"), strict)).alias("_bad"))
        rows = rows.join(known, F.col("_host") == F.col("_name"), "left")
        error = error.when(~literal & F.col("_bad").isNull(), "DNS resolution failed")
        if block_private:
            error = error.when(~literal & F.col("_bad"), "Resolved IP address is blocked")
    rows = rows.withColumn("error", error)
    return rows.withColumn("safe", F.col("error").isNull()).drop("_host", "_name", "_bad")


def needs_browser(url: Column) -> Column:
    return F.coalesce(within(U.hostname(url), BROWSER_HOSTS), F.lit(False))


def blocks_request(request: Column, page: Column, kind: Column) -> Column:
    """Whether a page's request to another origin is blocked: trackers, and scripts that no content network serves."""
    tracker, network = F.lit(False), F.lit(False)
    for t in TRACKERS:
        tracker = tracker | F.contains(request, F.lit(t))
    for n in NETWORKS:
        network = network | F.contains(request, F.lit(n))
    other = U.origin(request) != U.origin(page)
    return F.coalesce(U.origin(request).isNull() | (other & (tracker | (~network & (kind == "script")))), F.lit(True))


def render_fallback(content_type: Column, body_bytes: Column, content: Column, outline_size: Column) -> Column:
    """A page that probably needs a browser: large, but with little text."""
    words = Rx(r"\S+").count(content)
    asks = Rx(r"enable\s+javascript|enable\s+js|requires\s+javascript|turn\s+on\s+javascript", "i").test(content)
    thin = (words < 40) | ((words < 80) & (body_bytes >= 20000)) | ((outline_size == 0) & (words < 200) & (body_bytes >= 10000))
    return F.contains(content_type, F.lit("html")) & (body_bytes >= 5000) & (asks | thin)


def readability_fits(whole_words: Column, read_words: Column) -> Column:
    """Whether the extracted article holds enough of the page to stand for it."""
    short = (whole_words >= 600) & (read_words / whole_words < 0.35)
    return ~((read_words == 0) | short | ((whole_words >= 300) & (read_words < 120)))


# --- crawl rules ----------------------------------------------------------------


#: Fixed value: the beginning of a delay that is read as its number.
DELAY = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def agent_names(agent: str, aliases: tuple[str, ...] = ("inkwell",)) -> tuple[str, ...]:
    """What a group of rules may call an agent: the first word of its name, the whole of it, its aliases, and ``*``."""
    whole = agent.strip().lower()
    return tuple(dict.fromkeys([re.split(r"[\s/]+", whole)[0] or whole, whole, *aliases, "*"]))


def parse_robots(files: DataFrame, agents: tuple[str, ...]) -> DataFrame:
    """(origin, allow, pattern, crawl_delay): one row a rule that holds for the agents, and the file's last delay.

    Rules follow the last ``User-agent`` line before them; ``*`` holds for all.
    Lines that begin with a number sign are comments. A delay counts up to where
    it stops being a number. A file that is missing or wasn't served (status
    other than 200) has none. :func:`..sources.web.rules_of` reads one file alike.
    """
    names = [a.lower() for a in agents] + ["*"]
    lines = files.where("status = 200 and body is not null").select("origin", F.posexplode(F.split("body", r"\n")).alias("at", "line"))
    bare = trim(F.col("line"))
    lines = lines.where(~bare.startswith("#"))
    lines = lines.select("origin", "at", F.lower(trim(F.regexp_extract(bare, "^([^:]*):", 1))).alias("name"), trim(F.regexp_extract(bare, "^[^:]*:(.*)$", 1)).alias("value"))
    token = F.lower(F.col("value"))
    mine = F.when(F.col("name") == "user-agent", token.isin(*names))
    upto = Window.partitionBy("origin").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("mine", F.coalesce(F.last(mine, ignorenulls=True).over(upto), F.lit(False))).where("mine")
    rules = lines.where("name in ('allow', 'disallow') and value <> ''").select("origin", (F.col("name") == "allow").alias("allow"), F.col("value").alias("pattern"))
    delay = F.regexp_extract("value", DELAY, 0).try_cast("double")
    delays = lines.where((F.col("name") == "crawl-delay") & (delay > 0)).groupBy("origin").agg(F.max_by(delay, "at").alias("crawl_delay"))
    return rules.join(delays, "origin", "full")


def path_matches(path: Column, pattern: Column) -> Column:
    """``*`` stands for anything and makes the rest a beginning; ``$`` at the end means all of the path."""
    quoted = F.regexp_replace(pattern, r"([.+?^${}()|\[\]\\])", r"\\$1")
    by_star = F.regexp_like(path, F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*")))
    exact = path == F.regexp_replace(pattern, r"\$$", "")
    return F.when(F.contains(pattern, F.lit("*")), by_star).when(pattern.endswith("$"), exact).otherwise(F.startswith(path, pattern))


def robots_verdict(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with ``allowed`` and ``crawl_delay``: the longest matching rule decides, allow at a tie, allow if none.

    Rules of a URL's origin are few, so they are gathered to one row an origin
    and looked through in place; the URLs are joined once and not multiplied.
    """
    per = rules.groupBy(F.col("origin").alias("_origin")).agg(
        F.collect_list(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), "allow", "pattern"))).alias("_rules"),
        F.max("crawl_delay").alias("crawl_delay"),
    )
    target = F.concat(U.path(F.col(url_col)), F.regexp_extract(url_col, r"(\?[^#]*)", 1))
    rows = urls.withColumn("_at", U.origin(F.col(url_col))).withColumn("_path", target)
    rows = rows.join(per, F.col("_at") == F.col("_origin"), "left")
    best = F.array_max(F.filter("_rules", lambda r: path_matches(F.col("_path"), r["pattern"])))
    return rows.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_at", "_path", "_origin", "_rules")
