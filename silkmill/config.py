"""Engine settings, in layers (defaults, then profile, environment and call), with range and relation checks."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    workers: int = 8
    html_budget: int = 5000
    frontier_cap: int = 20000
    hub_cap: int = 32
    lease_seconds: int = 60
    lease_recovery_batch: int = 10
    startup_recovery_batch: int = 100
    politeness_floor_ms: int = 5000
    base_backoff_ms: int = 100
    max_backoff_ms: int = 300_000
    max_jitter_ms: int = 250
    max_attempts_timeout: int = 3
    max_attempts_overload: int = 5
    max_attempts_capacity: int = 3
    max_attempts_db: int = 5
    robots_retry_minutes: int = 2
    robots_max_minutes: int = 10
    primary_weight: float = 0.18
    secondary_weight: float = 0.09
    occurrence_cap: int = 128
    seed_score: float = 1000.0
    crawl_hosts: tuple[str, ...] = ("github.com", "www.github.com")
    deny_subpaths: tuple[str, ...] = tuple("blob discussions issues labels pull pulls".split())
    binary_suffixes: tuple[str, ...] = tuple("ipynb py txt yaml".split())
    max_url_length: int = 3000
    top_k: int = 5
    candidate_k: int = 20
    max_context_chars: int = 7000

    def validate(self, max_keyword_score: float | None = None) -> EngineConfig:
        bad = []
        positive = ("workers", "html_budget", "frontier_cap", "lease_seconds", "lease_recovery_batch", "startup_recovery_batch", "base_backoff_ms", "max_attempts_timeout", "max_attempts_overload", "max_attempts_capacity", "max_attempts_db", "robots_retry_minutes", "occurrence_cap", "max_url_length", "top_k", "candidate_k", "max_context_chars")
        bad += [f"{n} must be positive" for n in positive if getattr(self, n) <= 0]
        bad += [f"{n} must not be negative" for n in ("hub_cap", "politeness_floor_ms", "max_jitter_ms", "primary_weight", "secondary_weight") if getattr(self, n) < 0]
        if self.max_backoff_ms < self.base_backoff_ms:
            bad.append("max_backoff_ms is under base_backoff_ms")
        if self.robots_max_minutes < self.robots_retry_minutes:
            bad.append("robots_max_minutes is under robots_retry_minutes")
        if max_keyword_score is not None and self.seed_score <= max_keyword_score:
            bad.append("seed_score must be over every keyword score")
        if bad:
            raise ValueError("; ".join(bad))
        return self


def _parsed(value: str, like: object) -> object:
    if isinstance(like, tuple):
        return tuple(x.strip() for x in value.split(",") if x.strip())
    return type(like)(value)


def layered(*layers: Mapping[str, str], environ: Mapping[str, str] | None = None, prefix: str = "SILKMILL_", **call: object) -> EngineConfig:
    """Later layers win; then variables of the environment (prefix and upper-case name), then the call's own values."""
    base = EngineConfig()
    env = os.environ if environ is None else environ
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    values: dict[str, object] = {}
    for layer in layers:
        unknown = set(layer) - set(known)
        if unknown:
            raise KeyError(f"unknown settings: {sorted(unknown)}")
        values |= {k: _parsed(v, known[k]) if isinstance(v, str) else v for k, v in layer.items()}
    values |= {k: _parsed(env[prefix + k.upper()], v) for k, v in known.items() if prefix + k.upper() in env}
    return replace(base, **(values | call))
