"""Pipeline configuration: text with variables, YAML, validated dataclasses."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from .operators.flow import Backpressure, Retry

_VARIABLE = re.compile(r"\$(?:\$|\{([A-Za-z_][A-Za-z0-9_]*)(?::([-?])([^}]*))?\}|\{)")


class ConfigError(ValueError):
    """A configuration that can't be run."""


def interpolate(text: str, env: Mapping[str, str] | None = None) -> str:
    """`${V}` is the variable, an error if unset; `${V:-d}` is d and `${V:?m}` the error m if V is unset or empty; `$$` is a
    dollar sign. It works on the text before YAML is read, so values must not hold line breaks."""
    env = os.environ if env is None else env

    def put(m: re.Match) -> str:
        if m[0] == "$$":
            return "$"
        if m[1] is None:
            raise ConfigError(f"a variable that is not closed or named at {m.start()}")
        value = env.get(m[1])
        if m[2] and not value:
            if m[2] == "?":
                raise ConfigError(f"{m[1]}: {m[3] or 'is not set'}")
            return m[3]
        if value is None:
            raise ConfigError(f"{m[1]} is not set")
        if "\n" in value or "\r" in value:
            raise ConfigError(f"{m[1]} holds a line break")
        return value

    return _VARIABLE.sub(put, text)


def duration_ms(text: str | int) -> int:
    """`250ms`, `5s`, `2m`, `1h`, or a number of milliseconds."""
    m = re.fullmatch(r"(\d+)(ms|s|m|h)?", str(text).strip())
    if not m:
        raise ConfigError(f"{text!r} is no duration")
    return int(m[1]) * {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, None: 1}[m[2]]


@dataclass(frozen=True)
class BatchConfig:
    max_rows: int = 500_000
    max_bytes: int = 128 << 20
    linger_ms: int = 1000
    max_in_flight: int = 2

    def __post_init__(self) -> None:
        if min(self.max_rows, self.max_bytes, self.linger_ms, self.max_in_flight) < 1:
            raise ConfigError("batch limits must be positive")


@dataclass(frozen=True)
class SinkConfig:
    kind: str
    options: dict = field(default_factory=dict)
    batch: BatchConfig = field(default_factory=BatchConfig)
    retry: Retry = field(default_factory=Retry)


@dataclass(frozen=True)
class PipelineConfig:
    name: str
    source: dict
    sinks: dict[str, SinkConfig]
    commit_interval_ms: int = 5000
    max_pending_batches: int = 1024
    stalled_fail_after_ms: int = 120_000
    high: float = 0.8
    low: float = 0.5

    def __post_init__(self) -> None:
        if not self.name or not self.sinks or not self.source:
            raise ConfigError("a pipeline needs a name, a source and a sink")
        if min(self.commit_interval_ms, self.max_pending_batches, self.stalled_fail_after_ms) < 1:
            raise ConfigError("intervals must be positive")
        try:
            Backpressure(high=self.high, low=self.low)
        except ValueError as e:
            raise ConfigError(str(e)) from None

    @classmethod
    def from_text(cls, text: str, env: Mapping[str, str] | None = None) -> PipelineConfig:
        import yaml

        raw = yaml.safe_load(interpolate(text, env)) or {}
        known = {"pipeline", "source", "sink", "sinks", "checkpoint", "backpressure"}
        if unknown := set(raw) - known:
            raise ConfigError(f"unknown sections: {sorted(unknown)}")
        if ("sink" in raw) == ("sinks" in raw):
            raise ConfigError("exactly one of sink and sinks is needed")
        sections = {"default": raw["sink"]} if "sink" in raw else raw["sinks"]
        if "sinks" in raw and any(n in ("", "sink") for n in sections):
            raise ConfigError("a sink's name must not be empty or `sink`")
        sinks = {n: _sink(s) for n, s in sections.items()}
        checkpoint, pressure = raw.get("checkpoint", {}), raw.get("backpressure", {})
        return cls(
            raw.get("pipeline", {}).get("name", ""), raw.get("source", {}), sinks,
            duration_ms(checkpoint.get("interval", 5000)), checkpoint.get("max_pending_batches", 1024), duration_ms(checkpoint.get("stalled_fail_after", 120_000)),
            pressure.get("high", 0.8), pressure.get("low", 0.5),
        )


def _sink(section: dict) -> SinkConfig:
    section = dict(section)
    batch, retry = dict(section.pop("batch", {})), dict(section.pop("retry", {}))
    if len(section) != 1:
        raise ConfigError("a sink has exactly one kind")
    kind, options = next(iter(section.items()))
    if "linger" in batch:
        batch["linger_ms"] = duration_ms(batch.pop("linger"))
    for k in ("initial", "cap"):
        if k in retry:
            retry[f"{k}_ms"] = duration_ms(retry.pop(k))
    try:
        return SinkConfig(kind, options or {}, BatchConfig(**batch), Retry(**retry))
    except (TypeError, ValueError) as e:
        raise ConfigError(str(e)) from None
