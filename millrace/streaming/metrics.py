"""Counters of streaming queries, taken from progress events and observations."""

from __future__ import annotations

import logging
import time
from collections import Counter
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Meter:
    """Named counters and gauges under a prefix; some roots are reserved for the engine's own."""

    RESERVED = ("source", "sink", "checkpoint", "pipeline")

    def __init__(self, prefix: str = "millrace") -> None:
        self.prefix = prefix
        self.values: Counter = Counter()

    def _name(self, name: str) -> str:
        if name.split("_")[0] in self.RESERVED:
            raise ValueError(f"{name} starts with a reserved word")
        return f"{self.prefix}_{name}"

    def add(self, name: str, n: float = 1) -> None:
        self.values[self._name(name) + "_total"] += n

    def set(self, name: str, value: float) -> None:
        self.values[self._name(name)] = value


class ProgressMeter(StreamingQueryListener):
    """Rows in, batches, duration and observed aggregates of all queries of a session."""

    def __init__(self, prefix: str = "millrace") -> None:
        self.prefix = prefix
        self.values: Counter = Counter()

    def onQueryStarted(self, event) -> None:
        self.values[f"{self.prefix}_pipeline_started_total"] += 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.values[f"{self.prefix}_source_records_total"] += p.numInputRows
        self.values[f"{self.prefix}_pipeline_batches_total"] += 1
        self.values[f"{self.prefix}_pipeline_batch_ms"] = p.batchDuration
        for name, row in (p.observedMetrics or {}).items():
            for k, v in row.asDict().items():
                if isinstance(v, (int, float)):
                    self.values[f"{self.prefix}_{name}_{k}_total"] += v

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.values[f"{self.prefix}_pipeline_{'failed' if event.exception else 'completed'}_total"] += 1


class RateLimit(logging.Filter):
    """Lets n records through in each window of seconds and says how many it held back."""

    def __init__(self, n: int, window: float, clock: Callable[[], float] = time.monotonic) -> None:
        super().__init__()
        self.n, self.window, self.clock = n, window, clock
        self.start, self.seen, self.held = clock(), 0, 0

    def filter(self, record: logging.LogRecord) -> bool:
        now = self.clock()
        if now - self.start >= self.window:
            if self.held:
                record.msg = f"{record.msg} ({self.held} like it were held back)"
            self.start, self.seen, self.held = now, 0, 0
        self.seen += 1
        if self.seen > self.n:
            self.held += 1
            return False
        return True
