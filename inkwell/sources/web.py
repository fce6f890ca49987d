"""Pages by URL as a data source.

``spark.dataSource.register(WebPages)``, then
``spark.read.format("webpages").option("urls", ...).load()`` for a short list, or
:func:`fetched` for URLs in a table. A partition reads the URLs of some hosts,
so that a host's limit is kept by one task. The transport is a function from
request to response; the default uses the standard library and, with the
resolver of names, is the only place that touches the network. Every hop of
every URL passes a :class:`Gate`.
"""

from __future__ import annotations

import gzip
import json
import re
import socket
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import urls as U
from ..functions.regex import SPACES
from ..operators import gates
from ..operators.scans import SECOND
from ..streaming import caches, limits

SCHEMA = (
    "original_url string, final_url string, status int, headers map<string,string>, content_type string, body binary, "
    "retrieved_at timestamp, error_code string, error_message string"
)
#: Attempts, and the milliseconds between them at first and at most.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 3, 1000, 10_000
#: Fixed value: bytes of a file of crawl rules at most.
RULES_BYTES = 512_000
_SOCKET = ("ECONNRESET", "ETIMEDOUT", "ECONNREFUSED", "timed out", "reset")


@dataclass
class Response:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""


Transport = Callable[[str, dict, int, float], Response]


class FetchError(Exception):
    """``retry_after``: seconds that the server asks to wait; ``network``: it didn't answer at all."""

    def __init__(self, code: str, message: str, retryable: bool = False, retry_after: float | None = None, network: bool = False) -> None:
        super().__init__(message)
        self.code, self.retryable, self.retry_after, self.network = code, retryable, retry_after, network


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def http(url: str, headers: dict, max_bytes: int, timeout: float) -> Response:
    """One GET; redirects are answers like others, and a byte more than allowed is read to know that there is one."""
    opener = urllib.request.build_opener(_Stay)
    try:
        with opener.open(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return Response(r.status, {k.lower(): v for k, v in r.headers.items()}, r.read(max_bytes + 1))
    except urllib.error.HTTPError as e:
        return Response(e.code, {k.lower(): v for k, v in e.headers.items()}, e.read(max_bytes + 1))


def decompress(body: bytes, codings: str, max_bytes: int) -> bytes:
    """The body without its codings, last one first, never more than allowed."""
    for coding in reversed([c.strip().lower() for c in codings.split(",") if c.strip()]):
        if coding in ("identity", ""):
            continue
        if coding not in ("gzip", "x-gzip", "deflate"):
            raise FetchError("UNSUPPORTED_ENCODING", f"Unsupported content encoding: {coding}")
        try:
            d = zlib.decompressobj(31 if "gzip" in coding else 15)
            try:
                body = d.decompress(body, max_bytes + 1)
            except zlib.error:
                if coding != "deflate":
                    raise
                body = zlib.decompressobj(-15).decompress(body, max_bytes + 1)
        except (zlib.error, gzip.BadGzipFile) as e:
            raise FetchError("DECOMPRESSION_FAILED", str(e)) from e
        if len(body) > max_bytes:
            raise FetchError("CONTENT_TOO_LARGE", f"Content exceeds {max_bytes} bytes")
    return body


def get(url: str, transport: Transport = http, gate: Callable[[str], tuple[str, str] | None] = lambda _: None, headers: dict | None = None, max_bytes: int = 10_485_760, timeout: float = 30.0, max_redirects: int = 5, checked: bool = False) -> tuple[str, Response]:
    """The final URL and its response. Every hop passes the gate (the first one, too, unless it is ``checked``); a URL that comes twice is a loop."""
    seen: set[str] = set()
    for hop in range(max_redirects + 1):
        try:
            scheme = urlsplit(url).scheme
        except ValueError as e:
            raise FetchError("INVALID_REDIRECT" if hop else "INVALID_URL", str(e)) from e
        if scheme not in ("http", "https"):
            raise FetchError("INVALID_PROTOCOL", f"Protocol not allowed: {url}")
        if url in seen:
            raise FetchError("REDIRECT_LOOP", f"Redirect loop at {url}")
        if not (checked and not hop) and (stop := gate(url)):
            raise FetchError(*stop)
        seen.add(url)
        try:
            r = transport(url, headers or {}, max_bytes, timeout)
        except FetchError:
            raise
        except Exception as e:
            raise FetchError("FETCH_ERROR", str(e), any(s in str(e) for s in _SOCKET), network=True) from e
        if 300 <= r.status < 400:
            if not r.headers.get("location"):
                raise FetchError("INVALID_REDIRECT", "Redirect without a location")
            try:
                url = urljoin(url, r.headers["location"])
            except ValueError as e:
                raise FetchError("INVALID_REDIRECT", str(e)) from e
            continue
        if not 200 <= r.status < 300:
            asked = re.match(gates.DELAY, r.headers.get("retry-after", "").strip(), re.ASCII) if r.status == 429 else None
            raise FetchError(f"HTTP_{r.status}", f"HTTP {r.status}", r.status == 429 or r.status >= 500, float(asked[0]) if asked else None)
        length = r.headers.get("content-length") or ""
        # a length that is no number says nothing; the body is measured anyway
        if len(r.body) > max_bytes or (length.isascii() and length.isdigit() and int(length) > max_bytes):
            raise FetchError("CONTENT_TOO_LARGE", f"Content exceeds {max_bytes} bytes")
        return url, Response(r.status, r.headers, decompress(r.body, r.headers.get("content-encoding", ""), max_bytes))
    raise FetchError("TOO_MANY_REDIRECTS", f"More than {max_redirects} redirects")


def get_with_retry(url: str, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep, **options) -> tuple[str, Response]:
    """As :func:`get`, again after a growing wait if the error may pass."""
    for k in range(attempts):
        try:
            return get(url, **options)
        except FetchError as e:
            if not e.retryable or k + 1 == attempts:
                raise
            sleep(min(FIRST_WAIT * 2**k, LONGEST_WAIT) / 1000)
    raise FetchError("UNKNOWN_ERROR", "no attempt was made")


def addresses(host: str) -> list[str]:
    """What a name resolves to; an address resolves to itself."""
    return sorted({a[4][0].split("%")[0] for a in socket.getaddrinfo(host, None)})


def blocked_address(address: str) -> bool:
    """As :func:`inkwell.operators.gates.blocked_ip` in strict mode, for one address."""
    low = address.lower()
    if ":" in low:
        return low.startswith(gates.IPV6_BEGINNINGS) or bool(re.match(gates._STRICT, low))
    if not re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", low, re.ASCII) or any(int(x) > 255 for x in low.split(".")):
        return True
    return any(gates._number(a) <= gates._number(low) <= gates._number(b) for a, b in gates.IPV4_RANGES)


def rules_of(text: str, agents: tuple[str, ...]) -> tuple[list[tuple[bool, str]], float]:
    """(allow, pattern) of the rules that hold for an agent of these names, and the seconds between its requests; as :func:`inkwell.operators.gates.parse_robots`."""
    rules, delay, mine = [], 0.0, False
    for line in text.split("\n"):
        line = line.strip(SPACES)
        name, colon, value = line.partition(":")
        name, value = name.strip(SPACES).lower(), value.strip(SPACES)
        if not colon or line.startswith("#"):
            continue
        if name == "user-agent":
            mine = value.lower() in (*agents, "*")
        elif mine and name in ("allow", "disallow") and value:
            rules.append((name == "allow", value))
        elif mine and name == "crawl-delay" and (number := re.match(gates.DELAY, value, re.ASCII)) and float(number[0]) > 0:
            delay = float(number[0])
    return rules, delay


def rule_matches(path: str, pattern: str) -> bool:
    if "*" in pattern:
        return bool(re.match(".*".join(map(re.escape, pattern.split("*"))), path))
    return path == pattern[:-1] if pattern.endswith("$") else path.startswith(pattern)


class Gate:
    """Says why a URL may not be fetched, or None: its host's addresses, then the crawl rules of its origin.

    Names are resolved here and again by the transport, so a name that changes
    in between isn't caught; a transport behind a filtering proxy closes that.
    Rules are fetched once an origin and quarter of an hour, by hops that pass
    the address check, too; an origin that serves none allows all. ``pause``
    keeps the delay that the rules ask for between requests to an origin.
    """

    def __init__(
        self, transport: Transport = http, resolve: Callable[[str], list[str]] = addresses, agent: str = "inkwell", robots: bool = True, allow: tuple[str, ...] = (),
        clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
    ) -> None:
        self.transport, self.resolve, self.agent, self.robots, self.allow = transport, resolve, agent, robots, tuple(d.lower() for d in allow)
        self.names = gates.agent_names(agent)
        self.clock, self.sleep = clock, sleep
        self.rules = caches.Cache(caches.CRAWL_RULES, caches.CRAWL_RULES_TTL * SECOND)
        self.due: dict[str, float] = {}

    def unsafe(self, url: str) -> tuple[str, str] | None:
        try:
            host = (urlsplit(url).hostname or "").rstrip(".").lower()
        except ValueError:
            host = ""
        if not host:
            return "INVALID_URL", "Invalid URL"
        if self.allow and not any(host == d or host.endswith("." + d) for d in self.allow):
            return "SSRF_BLOCKED", "Domain not in allowlist"
        if host == "localhost" or host.endswith(".localhost"):
            return "SSRF_BLOCKED", "Localhost is blocked"
        try:
            found = self.resolve(host)
        except OSError:
            found = []
        if not found:
            return "SSRF_BLOCKED", "DNS resolution failed"
        return ("SSRF_BLOCKED", "Resolved IP address is blocked") if any(map(blocked_address, found)) else None

    def rules_at(self, origin: str) -> tuple[list, float]:
        now = int(self.clock() * SECOND)
        if kept := self.rules.get(origin, now):
            return kept
        try:
            _, r = get(f"{origin}/robots.txt", self.transport, self.unsafe, {"user-agent": self.agent}, RULES_BYTES)
            found = rules_of(r.body.decode("utf-8", "replace"), self.names) if r.status == 200 else ([], 0.0)
        except FetchError:
            found = [], 0.0
        self.rules.set(origin, found, now)
        return found

    def __call__(self, url: str) -> tuple[str, str] | None:
        if (stop := self.unsafe(url)) or not self.robots:
            return stop
        parts = urlsplit(url)
        path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        origin = f"{parts.scheme}://{parts.netloc}"
        rules, delay = self.rules_at(origin)
        best = max(((len(p), allow) for allow, p in rules if rule_matches(path, p)), default=(0, True))
        if not best[1]:
            return "ROBOTS_BLOCKED", "Disallowed by the site's crawl rules"
        if delay:
            self.pause(origin, delay)
        return None

    def pause(self, origin: str, delay: float) -> None:
        now = self.clock()
        start = max(now, self.due.get(origin, now))
        if start > now:
            self.sleep(start - now)
        self.due[origin] = start + delay


class Memory:
    """What a task keeps between fetches: responses for a while, and each host's requests of the last minute.

    A response that is kept needs no request. A request beyond a host's limit
    waits for a slot, half a minute at most; a server that asks for a pause, or
    doesn't answer, gets one.
    """

    def __init__(
        self, per_host: int = 60, ttl_seconds: int = 300, capacity: int = caches.RESPONSES, hosts: int = 1000,
        clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
    ) -> None:
        self.per_host, self.clock, self.sleep = per_host, clock, sleep
        self.responses = caches.Cache(capacity, ttl_seconds * SECOND) if ttl_seconds > 0 else None
        # a limiter that nobody asked for an hour has forgotten all anyway
        self.limiters = caches.Cache(hosts, 3600 * SECOND)

    def _now(self) -> int:
        return int(self.clock() * SECOND)

    def _limiter(self, url: str) -> limits.Limiter:
        host, now = (urlsplit(url).hostname or "").lower(), self._now()
        limiter = self.limiters.get(host, now) or limits.Limiter(self.per_host)
        self.limiters.set(host, limiter, now)
        return limiter

    def found(self, key: str) -> tuple[str, Response] | None:
        return self.responses.get(key, self._now()) if self.responses else None

    def keep(self, key: str, answer: tuple[str, Response]) -> None:
        if self.responses:
            self.responses.set(key, answer, self._now())

    def turn(self, url: str) -> None:
        """Waits for a slot, or says that there is none soon enough."""
        admitted, wait = self._limiter(url).request(self._now())
        if not admitted:
            raise FetchError("RATE_LIMITED", "Rate limit exceeded for this host", True)
        if wait:
            self.sleep(wait / SECOND)

    def failed(self, url: str, error: FetchError) -> None:
        if error.code == "HTTP_429" or error.network:
            self._limiter(url).error(self._now(), error.retry_after)


def fetched(
    urls: DataFrame, url_col: str = "url", transport: Transport = http, resolve: Callable[[str], list[str]] = addresses, agent: str = "inkwell/1", robots: bool = True, allow: tuple[str, ...] = (),
    per_host: int = 60, ttl_seconds: int = 300, **options,
) -> DataFrame:
    """Pages of all URLs of a table, as rows of ``SCHEMA``; one that can't be fetched has its error.

    A host's URLs go to one task, as one task keeps its delay and its limit;
    hosts are dealt by hash. A row is passed on once it is read, so a task holds
    one body and the last responses (:class:`Memory`).
    """
    headers = {"user-agent": agent}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, memory = Gate(transport, resolve, agent, robots, allow), Memory(per_host, ttl_seconds)
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        for frame in frames:
            for url in frame["url"]:
                yield pd.DataFrame([row_of(url, memory, transport=transport, gate=gate, headers=headers, **options)], columns=names)

    rows = urls.select(urls[url_col].alias("url")).where("url is not null")
    return rows.repartition(U.hostname(rows["url"])).mapInPandas(run, SCHEMA)


def row_of(url: str, memory: Memory | None = None, gate: Callable[[str], tuple[str, str] | None] = lambda _: None, **options) -> tuple:
    """A row for a URL, also if it can't be fetched: gates first, then what is kept, then a turn at its host, then the request."""
    now = datetime.now(UTC)
    try:
        if memory is None:
            final, r = get_with_retry(url, gate=gate, **options)
        else:
            final, r = _remembered(url, memory, gate, options)
        return url, final, r.status, r.headers, r.headers.get("content-type", ""), r.body, now, None, None
    except FetchError as e:
        return url, None, None, None, None, None, now, e.code, str(e)


def _remembered(url: str, memory: Memory, gate: Callable[[str], tuple[str, str] | None], options: dict) -> tuple[str, Response]:
    try:
        scheme = urlsplit(url).scheme
    except ValueError as e:
        raise FetchError("INVALID_URL", str(e)) from e
    if scheme not in ("http", "https"):
        raise FetchError("INVALID_PROTOCOL", f"Protocol not allowed: {url}")
    if stop := gate(url):
        raise FetchError(*stop)
    key = json.dumps([url, sorted((options.get("headers") or {}).items()), options.get("max_bytes"), options.get("max_redirects")])
    if kept := memory.found(key):
        return kept
    memory.turn(url)
    try:
        answer = get_with_retry(url, gate=gate, checked=True, **options)
    except FetchError as e:
        memory.failed(url, e)
        raise
    memory.keep(key, answer)
    return answer


class _Hosts(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class WebPages(DataSource):
    """Options: ``urls`` (JSON list), ``partitions``, ``max_bytes``, ``timeout_ms``, ``max_redirects``, ``user_agent``, ``respect_robots`` (true), ``allow`` (comma-separated domains), ``rate_limit_per_host``, ``cache_ttl_s``.

    For a list that fits a setting; URLs of a table go to :func:`fetched`.
    """

    @classmethod
    def name(cls) -> str:
        return "webpages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    transport: Transport = staticmethod(http)
    resolve: Callable[[str], list[str]] = staticmethod(addresses)

    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        count = int(self.options.get("partitions", 8))
        hosts: dict[str, list[str]] = {}
        for url in json.loads(self.options.get("urls", "[]")):
            try:
                host = urlsplit(url).netloc
            except ValueError:
                host = ""
            hosts.setdefault(host, []).append(url)
        parts: list[list[str]] = [[] for _ in range(max(1, min(count, len(hosts))))]
        for urls in sorted(hosts.values(), key=len, reverse=True):
            min(parts, key=len).extend(urls)
        return [_Hosts(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        agent, allow = o.get("user_agent", "inkwell/1"), tuple(d.strip() for d in o.get("allow", "").split(",") if d.strip())
        gate = Gate(self.transport, self.resolve, agent, o.get("respect_robots", "true").lower() == "true", allow)
        options = dict(
            transport=self.transport, gate=gate, max_bytes=int(o.get("max_bytes", 10_485_760)), timeout=int(o.get("timeout_ms", 30_000)) / 1000,
            max_redirects=int(o.get("max_redirects", 5)), headers={"user-agent": agent},
        )
        memory = Memory(int(o.get("rate_limit_per_host", 60)), int(o.get("cache_ttl_s", 300)))
        for url in partition.urls:
            yield row_of(url, memory, **options)
