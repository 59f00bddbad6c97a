"""Driver-side loaders: host rules, actions, job configurations, small flag parsers."""

from __future__ import annotations

import json
import re
import secrets
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from pagequarry import schemas

TIERS = ("http", "chromium")
FORMATS = ("", "html", "markdown", "json")


def _yaml_or_json(path: str) -> object:
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def parse_host_rules(raw: Mapping) -> list[tuple]:
    """(rule_idx, match, rate, concurrency, jitter) of a version 1 rule list; each rule overrides something."""
    if raw.get("version") != 1:
        raise ValueError(f"version {raw.get('version')} is not supported (1)")
    out = []
    for i, r in enumerate(raw.get("hosts") or raw.get("rules") or []):
        if not r.get("match"):
            raise ValueError(f"rule {i}: match is required")
        if all(r.get(k) is None for k in ("rate", "concurrency", "jitter")):
            raise ValueError(f"rule {i}: nothing is overridden")
        number = lambda k, kind: None if r.get(k) is None else kind(r[k])  # noqa: B023, E731
        out.append((i, str(r["match"]), number("rate", float), number("concurrency", int), number("jitter", float)))
    return out


def load_host_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(parse_host_rules(_yaml_or_json(path)), schemas.HOST_RULES)


@dataclass(frozen=True)
class Action:
    type: str
    selector: str = ""
    value: str = ""

    def check(self) -> Action:
        needs = {"click": ("selector",), "wait": ("selector",), "scroll": ("selector",), "type": ("selector", "value"), "sleep": ("value",), "evaluate": ("value",)}
        if self.type not in needs:
            raise ValueError(f"unknown action type {self.type!r}" if self.type else "action type is required")
        for n in needs[self.type]:
            if not getattr(self, n):
                raise ValueError(f"{self.type} requires a {n}")
        if self.type == "sleep":
            duration_ms(self.value)
        return self


_UNITS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1.0, "s": 1e3, "m": 6e4, "h": 3.6e6}


def duration_ms(text: str) -> float:
    """Milliseconds of a duration such as 1h30m, 2s or 500ms."""
    t = text.strip()
    if not re.fullmatch(r"[+-]?(\d+(\.\d*)?(ns|us|µs|ms|s|m|h))+|0", t):
        raise ValueError(f"duration {text!r}")
    ms = sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d*)?)(ns|us|µs|ms|s|m|h)", t))
    return -ms if t.startswith("-") else ms


def parse_action(spec: str) -> Action:
    """``click:sel``, ``wait:sel``, ``scroll:bottom``, ``type:sel=value``, ``sleep:2s``, ``evaluate:js``."""
    kind, colon, rest = spec.partition(":")
    if not colon:
        raise ValueError(f"invalid action {spec!r}: type:argument expected")
    if kind == "type":
        selector, _, value = rest.partition("=")
        return Action(kind, selector.strip(), value).check()
    return (Action(kind, "", rest) if kind in ("sleep", "evaluate") else Action(kind, rest)).check()


def load_actions(path: str) -> list[Action]:
    raw = _yaml_or_json(path)
    if raw.get("version") != 1:
        raise ValueError(f"version {raw.get('version')} is not supported (1)")
    if not raw.get("actions"):
        raise ValueError("actions list is empty")
    return [Action(a.get("type", ""), a.get("selector", ""), str(a.get("value", ""))).check() for a in raw["actions"]]


@dataclass
class JobConfig:
    """What a job is asked to do; saved as JSON so that it can be resumed."""

    id: str = ""
    tiers: list[str] = field(default_factory=lambda: list(TIERS))
    concurrency: int = 20
    rate: float = 1.0
    timeout: str = "30s"
    depth: int = 2
    limit: int = 1000
    same_domain: bool = True
    selectors: list[str] = field(default_factory=list)
    schema_path: str = ""
    format: str = ""
    readability: bool = False
    output: str = "results.jsonl"
    csv_columns: list[str] = field(default_factory=list)
    url_column: str = ""
    fallback_column: str = ""
    fallback_selector: str = ""
    cache_ttl: str = "24h"
    retries: int = 2
    retry_delay: str = "500ms"
    sources: str = "both"
    sitemap_max: int = 50_000
    #: One tier alone, without a ladder.
    force_tier: str = ""
    ignore_robots: bool = False
    burst: int = 1
    politeness_path: str = ""
    no_tier_learning: bool = False
    tier_cache_path: str = ""
    cache_enabled: bool = False
    cache_path: str = ""
    no_metadata: bool = False
    screenshot_dir: str = ""
    viewport: str = "1920x1080"
    browser_path: str = ""
    browser_args: list[str] = field(default_factory=list)
    proxy_url: str = ""
    proxy_file: str = ""
    rotate_on_status: str = ""
    rotate_retries: int = 2
    browser_like: bool = False
    user_agent_strategy: str = ""
    stealth: bool = False
    no_jitter: bool = False
    tls_match: str = ""
    actions: list[str] = field(default_factory=list)
    actions_path: str = ""
    ocr: bool = False
    ocr_lang: str = "eng"
    pdf_max_pages: int = 0
    crawl_seed: str = ""

    def check(self) -> JobConfig:
        if bool(self.fallback_column) != bool(self.fallback_selector):
            raise ValueError("fallback_column and fallback_selector go together")
        if self.csv_columns and not self.output.endswith((".csv", ".tsv")):
            raise ValueError("csv_columns need a .csv or .tsv output")
        if self.format not in FORMATS:
            raise ValueError(f"format {self.format!r}")
        if bad := {*self.tiers, self.force_tier or TIERS[0]} - set(TIERS):
            raise ValueError(f"unknown tiers {sorted(bad)}")
        if self.proxy_url and self.proxy_file:
            raise ValueError("proxy_url and proxy_file exclude each other")
        if self.actions and self.actions_path:
            raise ValueError("actions and actions_path exclude each other")
        parse_status_codes(self.rotate_on_status), parse_viewport(self.viewport), [parse_action(a) for a in self.actions]
        duration_ms(self.timeout), duration_ms(self.cache_ttl), duration_ms(self.retry_delay)
        return self

    @property
    def ladder(self) -> list[str]:
        return [self.force_tier] if self.force_tier else self.tiers

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2) + "\n")

    @classmethod
    def load(cls, path: str) -> JobConfig:
        raw = json.loads(Path(path).read_text())
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in raw.items() if k in known})


def new_id() -> str:
    """Name of a job: the time in UTC and six random bytes."""
    return f"{datetime.now(UTC):%Y%m%dT%H%M%S}-{secrets.token_hex(6)}"


def parse_status_codes(text: str) -> list[int]:
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        if not part.isdigit() or not 100 <= int(part) <= 599:
            raise ValueError(f"status code {part!r}")
        out.append(int(part))
    return out


def parse_viewport(text: str) -> tuple[int, int]:
    m = re.fullmatch(r"\s*(\d+)\s*[xX]\s*(\d+)\s*", text)
    if not m or not int(m[1]) or not int(m[2]):
        raise ValueError(f"viewport {text!r}: WxH expected")
    return int(m[1]), int(m[2])


def parse_tiers(text: str) -> list[str]:
    out = [t.strip() for t in text.split(",") if t.strip()]
    if not out or set(out) - set(TIERS):
        raise ValueError(f"tiers {text!r}")
    return out


def load_proxies(path: str) -> list[str]:
    """Proxy URLs, one a line; # lines and blank ones don't count."""
    out = []
    for line in Path(path).read_text().splitlines():
        t = line.strip()
        if t and not t.startswith("#"):
            if not re.match(r"^[a-z0-9+.-]+://[^/\s]+", t):
                raise ValueError(f"proxy {t!r}: scheme://host expected")
            out.append(t)
    return out


def mask_proxy(url: str) -> str:
    return re.sub(r"//[^/@]*@", "//***@", url)
