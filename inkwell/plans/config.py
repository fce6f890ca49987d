"""Settings from the environment, checked once; and a session set up for the engine."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

#: Other names of scopes.
SCOPES = {"global": "global", "workspace": "workspace", "project": "workspace", "cwd": "workspace", "conversation": "conversation", "thread": "conversation"}
#: Least and most of a setting.
BOUNDS = {
    "max_bytes": (1024, 104_857_600), "timeout_ms": (1000, 300_000), "max_redirects": (0, 20), "rate_limit_per_host": (1, 1000), "default_max_tokens": (100, None),
    "chunk_margin_ratio": (0.0, 0.5), "ai_search_max_file_bytes": (1024, None), "ai_search_query_timeout_ms": (1000, None), "ai_search_max_query_wait_ms": (0, None),
}
_REMOTE = ("cf_account_id", "r2_bucket", "r2_access_key_id", "r2_secret_access_key")


@dataclass(frozen=True)
class Config:
    max_bytes: int = 10_485_760
    timeout_ms: int = 30_000
    max_redirects: int = 5
    user_agent: str = "inkwell/1"
    block_private_ip: bool = True
    allowlist_domains: tuple[str, ...] = ()
    rate_limit_per_host: int = 60
    respect_robots: bool = True
    default_max_tokens: int = 4000
    chunk_margin_ratio: float = 0.10
    pdf_enabled: bool = True
    playwright_enabled: bool = False
    render_timeout_ms: int = 60_000
    render_block_third_party: bool = True
    cache_ttl_s: int = 300
    ai_search_enabled: bool = False
    ai_search_scope: str = "conversation"
    ai_search_thread_key: str = ""
    ai_search_require_thread_key: bool = False
    ai_search_max_file_bytes: int = 4_194_304
    ai_search_query_timeout_ms: int = 15_000
    ai_search_query_wait_ms: int = 0
    ai_search_max_query_wait_ms: int = 15_000
    cf_account_id: str = ""
    r2_bucket: str = ""
    r2_access_key_id: str = ""
    r2_secret_access_key: str = ""
    r2_prefix: str = ""

    def checked(self) -> Config:
        """Itself, or ValueError naming everything that is out of bounds."""
        wrong = []
        for name, (low, high) in BOUNDS.items():
            if (v := getattr(self, name)) < low or (high is not None and v > high):
                wrong.append(f"{name.upper()} must be {low} or more" + (f" and {high} or less" if high is not None else ""))
        if self.ai_search_enabled:
            wrong += [f"{n.upper()} is required when AI_SEARCH_ENABLED is true" for n in _REMOTE if not getattr(self, n)]
        if self.ai_search_require_thread_key and self.ai_search_scope == "conversation" and not self.ai_search_thread_key:
            wrong.append("AI_SEARCH_THREAD_KEY is required")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self


def _read(text: str, default):
    """A setting's text: booleans are true for ``true`` and ``1`` only; numbers take what they begin with."""
    if isinstance(default, bool):
        return text.lower() == "true" or text == "1"
    if isinstance(default, int | float):
        m = re.match(r"\s*[+-]?\d+(?:\.\d+)?" if isinstance(default, float) else r"\s*[+-]?\d+", text)
        return type(default)(m[0]) if m else default
    if isinstance(default, tuple):
        return tuple(x.strip() for x in text.split(",") if x.strip())
    return text


def load(env: Mapping[str, str] | None = None, **overrides) -> Config:
    """The settings that the environment names, then ``overrides``; checked."""
    env = os.environ if env is None else env
    found = {f.name: _read(env[f.name.upper()], f.default) for f in fields(Config) if env.get(f.name.upper())}
    config = replace(Config(), **(found | overrides))
    return replace(config, ai_search_scope=SCOPES.get(config.ai_search_scope.lower(), "conversation")).checked()


def session(name: str = "inkwell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC, and batches that bound what Python workers hold."""
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    defaults = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
