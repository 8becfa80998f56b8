"""Running split pipelines as Structured Streaming jobs: every branch of a micro-batch is written, or none is committed."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chain import Split
from ..operators.flow import Breaker, Retry

Writer = Callable[[DataFrame, int], None]


class FatalWriteError(RuntimeError):
    """A write that no retry can mend."""


@dataclass
class RunReport:
    completed: bool
    reason: str = ""
    batches: int = 0
    rows: int = 0
    offsets: list[str] = field(default_factory=list)

    @property
    def exit_code(self) -> int:
        return 0 if self.completed else 1


def parquet_writer(path: str) -> Writer:
    """Appends by batch id: a replayed batch overwrites its own folder, so retries leave no duplicates."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def table_writer(path: str, shard: str | None = None) -> Writer:
    """Like parquet_writer, with a folder for each shard, so that readers prune by shard."""

    def write(df: DataFrame, batch_id: int) -> None:
        w = df.repartition(shard).write.partitionBy(shard) if shard else df.write
        w.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def jsonl_writer(path: str) -> Writer:
    """One JSON object a line; a replayed batch overwrites its own folder."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return write


def with_breaker(writers: list[Writer], breaker: Breaker, clock: Callable[[], float] = time.monotonic) -> Writer:
    """Writes through the next replica that its breaker lets through; raises if none may be tried."""

    def write(df: DataFrame, batch: int) -> None:
        now = int(clock() * 1000)
        picked = breaker.pick(now)
        if picked is None:
            raise OSError("no replica may be tried now")
        try:
            writers[picked[0]](df, batch)
        except Exception:
            breaker.failure(picked[0], int(clock() * 1000))
            raise
        breaker.success(picked[0])

    return write


def capture_writer(into: list) -> Writer:
    """For tests: keeps (batch, rows) in memory."""
    return lambda df, batch: into.append((batch, [tuple(r) for r in df.collect()]))


def scripted_writer(inner: Writer, outcomes: list[str]) -> Writer:
    """For tests: each call takes the next outcome (ok, retryable, fatal); afterwards all are ok."""
    left = list(outcomes)

    def write(df: DataFrame, batch: int) -> None:
        what = left.pop(0) if left else "ok"
        if what == "fatal":
            raise FatalWriteError("scripted")
        if what == "retryable":
            raise OSError("scripted")
        inner(df, batch)

    return write


def is_fatal(error: BaseException) -> bool:
    """Whether no retry can mend an error. One raised on an executor reaches the driver as text, in which its class stands."""
    return isinstance(error, FatalWriteError) or FatalWriteError.__name__ in str(error)


def with_retry(writer: Writer, retry: Retry, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> Writer:
    """Repeats a write that may be mended; the waits are shortened by jitter, a fatal error ends it at once."""
    rng = rng or random.Random()

    def write(df: DataFrame, batch: int) -> None:
        n = 0
        while True:
            try:
                return writer(df, batch)
            except Exception as e:
                if is_fatal(e):
                    raise
                n += 1
                wait = retry.delay(n, rng)
                if wait is None:
                    raise
                sleep(wait / 1000)

    return write


def run_split(source: DataFrame, plan: Callable[[DataFrame], Split], writers: dict[str, Writer], checkpoint: str, available_now: bool = True, trigger: str = "5 seconds", name: str | None = None) -> StreamingQuery:
    """Starts the stream. `plan` builds the split from a batch; writers go by branch name."""

    def batch(df: DataFrame, batch_id: int) -> None:
        split = plan(df)
        split.write({b.name: (lambda part, w=writers[b.name]: w(part, batch_id)) for b in split.branches})

    w = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)).start()


def behind(progress: dict) -> list[str]:
    """The sources of a progress report whose last batch ended before what they had to offer."""
    out = []
    for s in progress.get("sources", []):
        end, latest = s.get("endOffset"), s.get("latestOffset")
        if latest is not None and _offset(end) != _offset(latest):
            out.append(f"{s.get('description', 'source')} ended at {end}, {latest} offered")
    return out


def _offset(x: object) -> object:
    try:
        return json.loads(x) if isinstance(x, str) else x
    except ValueError:
        return x


def drain(query: StreamingQuery, deadline_s: float, poll: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> RunReport:
    """Lets the batch at work end, until the deadline, then stops. What it abandons is told in the report."""
    end = clock() + deadline_s
    while query.isActive and query.status["isTriggerActive"] and clock() < end:
        poll(0.05)
    late = query.isActive and query.status["isTriggerActive"]
    query.stop()
    return RunReport(not late, "the batch at work was abandoned at the deadline" if late else "", *_progress(query))


def finish(query: StreamingQuery, timeout: float | None = None) -> RunReport:
    """Waits for the end and reports. A drained run is complete only if its last batch reached the source's end."""
    try:
        done = query.awaitTermination(timeout) if timeout else query.awaitTermination() is None
    except Exception as e:
        return RunReport(False, re.sub(r"\s+", " ", str(e))[:500], *_progress(query))
    if done is False:
        query.stop()
        return RunReport(False, "it did not end in time", *_progress(query))
    last = query.lastProgress
    left = behind(json.loads(last.json) if last is not None else {})
    return RunReport(not left, "; ".join(left), *_progress(query))


def _progress(query: StreamingQuery) -> tuple[int, int, list[str]]:
    seen = [p for p in query.recentProgress if p.numInputRows]
    return len(seen), sum(p.numInputRows for p in seen), [s.endOffset for s in seen[-1].sources] if seen else []


class StallWatch:
    """Says when a query has made no progress for too long."""

    def __init__(self, after_s: float = 120.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.after, self.clock = after_s, clock
        self.last: tuple[int, float] | None = None

    def stalled(self, batch_id: int, pending: bool = True) -> bool:
        now = self.clock()
        if self.last is None or self.last[0] != batch_id or not pending:
            self.last = (batch_id, now)
        return now - self.last[1] >= self.after


def read_branch(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a branch."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").withColumn("batch", F.col("batch").cast("long"))
