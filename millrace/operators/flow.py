"""Flow-control state machines: hysteresis backpressure, circuit breaker, retry schedule. Pure and deterministic."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class Backpressure:
    """Pauses on a rejection or at the high mark; resumes at the low mark with low queues after a least pause."""

    budget: int = 256 << 20
    high: float = 0.8
    low: float = 0.5
    min_pause_ms: int = 500
    paused_at: int | None = None

    def __post_init__(self) -> None:
        if not 0 < self.low < self.high <= 1:
            raise ValueError("marks must satisfy 0 < low < high <= 1")

    def step(self, now_ms: int, used: int, queues_low: bool = True, rejected: bool = False) -> str:
        """`pause`, `resume` or `hold`."""
        share = used / self.budget
        if self.paused_at is None:
            if rejected or share >= self.high:
                self.paused_at = now_ms
                return "pause"
        elif not rejected and share <= self.low and queues_low and now_ms - self.paused_at >= self.min_pause_ms:
            self.paused_at = None
            return "resume"
        return "hold"


class ByteBudget:
    """In-flight bytes; never below zero, never above the largest 64-bit number."""

    def __init__(self) -> None:
        self.used = 0

    def add(self, n: int) -> int:
        self.used = min(self.used + n, (1 << 64) - 1)
        return self.used

    def sub(self, n: int) -> int:
        self.used = max(self.used - n, 0)
        return self.used


@dataclass
class _Replica:
    failures: int = 0
    open_until: int | None = None
    half_open: bool = False
    probes: int = 0
    episode: int = 0


@dataclass
class Breaker:
    """A circuit breaker for each of several replicas, picked round-robin."""

    replicas: int
    threshold: int = 3
    open_for_ms: int = 5000
    half_open_probes: int = 1
    cursor: int = 0
    states: list[_Replica] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.states = [_Replica() for _ in range(self.replicas)]

    def state(self, i: int) -> str:
        s = self.states[i]
        return "half_open" if s.half_open else "open" if s.open_until is not None else "closed"

    def pick(self, now_ms: int) -> tuple[int, int] | None:
        """(replica, episode) of the next replica that may be tried, or None."""
        for k in range(self.replicas):
            i = (self.cursor + k) % self.replicas
            s = self.states[i]
            if s.open_until is not None and now_ms >= s.open_until:
                s.open_until, s.half_open, s.probes = None, True, 0
                s.episode += 1
            if s.open_until is not None or s.half_open and s.probes >= self.half_open_probes:
                continue
            s.probes += s.half_open
            self.cursor = (i + 1) % self.replicas
            return i, s.episode
        return None

    def success(self, i: int) -> None:
        self.states[i] = _Replica(episode=self.states[i].episode)

    def failure(self, i: int, now_ms: int) -> None:
        s = self.states[i]
        if s.open_until is not None:
            return
        s.failures += 1
        if s.half_open or s.failures >= self.threshold:
            s.half_open, s.open_until = False, now_ms + self.open_for_ms

    def release(self, i: int, episode: int) -> None:
        """Gives back a probe that was not used; one of an earlier episode is ignored."""
        s = self.states[i]
        if s.half_open and s.episode == episode and s.probes:
            s.probes -= 1


@dataclass(frozen=True)
class Retry:
    """Exponential backoff with a cap; jitter only shortens; attempts 0 means without end."""

    initial_ms: int = 100
    factor: float = 2.0
    cap_ms: int = 10_000
    jitter: float = 0.2
    attempts: int = 0

    def __post_init__(self) -> None:
        if self.initial_ms < 1 or self.factor < 1 or self.cap_ms < self.initial_ms or not 0 <= self.jitter <= 1:
            raise ValueError("a backoff needs initial > 0, factor >= 1, cap >= initial and jitter from 0 to 1")

    def delay(self, attempt: int, rng: random.Random | None = None) -> float | None:
        """Milliseconds before retry `attempt` (from 1), or None when no attempt is left."""
        if self.attempts and attempt >= self.attempts:
            return None
        base = min(self.cap_ms, self.initial_ms * self.factor ** min(attempt - 1, 1000)) if self.factor > 1 else self.initial_ms
        return base * (1 - self.jitter * (rng.random() if rng else 0.0))


def fold(df: DataFrame, by: str, order: list[str], start: Callable[[], object], step: Callable[[object, dict], str], column: str) -> DataFrame:
    """Runs a state machine over each key's rows (dicts) in order and adds its outcome. Rows stream through with constant
    state; the fold is bound to the order, so a key's rows pass one task."""
    names = df.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, machine = object(), None
        for pdf in parts:
            out = []
            for values in zip(*(pdf[c].tolist() for c in names), strict=True):
                row = dict(zip(names, values, strict=True))
                if row[by] != now:
                    now, machine = row[by], start()
                out.append(step(machine, row))
            yield pdf.assign(**{column: out})

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(column, T.StringType())])
    return df.repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)
