"""The warehouse sink's statements, settings and error classes; sending is a pluggable function."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame

from ..config import BatchConfig
from ..streaming.runtime import FatalWriteError, Writer
from . import encoders
from .schema_check import TargetColumn, parse_type

#: The server's exception codes that no retry mends, and settings that the sink sets itself.
FATAL_CODES = frozenset({6, 16, 20, 27, 53, 60, 73, 81, 117, 192, 497, 516})
RESERVED_SETTINGS = ("insert_deduplication_token", "insert_deduplicate", "wait_end_of_query")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def insert_statement(table: str, columns: list[str], form: str = "RowBinary") -> str:
    """INSERT with quoted names; names that are no identifiers are refused."""
    for n in [*table.split("."), *(p for c in columns for p in c.split("."))]:
        if not _NAME.fullmatch(n):
            raise ValueError(f"{n!r} is no identifier")
    quoted = ".".join(f"`{p}`" for p in table.split("."))
    return f"INSERT INTO {quoted} ({', '.join(f'`{c}`' for c in columns)}) FORMAT {form}"


def classify(message: str) -> str:
    """fatal or retryable, by the exception code that a server's answer names."""
    m = re.search(r"Code: (\d+)", message)
    return "fatal" if m and int(m[1]) in FATAL_CODES else "retryable"


@dataclass
class WarehouseSink:
    """Sends each shard's rows of a micro-batch in sealed batches with stable tokens, from the executors."""

    table: str
    columns: list[TargetColumn]
    endpoints: list[str]
    send: Callable[[str, str, dict, bytes], None]  # endpoint, statement, settings, body
    pipeline: str = "pipeline"
    run: str = "run"
    form: str = "RowBinary"
    settings: dict = field(default_factory=dict)
    batch: BatchConfig = field(default_factory=BatchConfig)

    def __post_init__(self) -> None:
        taken = [s for s in RESERVED_SETTINGS if s in self.settings]
        if taken:
            raise ValueError(f"{taken} are set by the sink")
        if self.form not in ("RowBinary", "Native") or not self.endpoints:
            raise ValueError("a sink needs endpoints and the format RowBinary or Native")
        self.statement = insert_statement(self.table, [c.name for c in self.columns], self.form)

    def bodies(self, rows: Iterable[dict]) -> Iterator[tuple[int, str, bytes]]:
        """(rows, reason, encoded) of each sealed batch: one is sealed once its rows or bytes reach the limit, so that it may
        overshoot by a row; the last one is sealed by the end of the input (drain). No more than a batch is held."""
        writers = [encoders.row_writer(parse_type(c.type)) for c in self.columns]
        held: list = []
        size = 0
        for r in rows:
            values = [r[c.name] for c in self.columns]
            encoded = b"".join(w(v) for w, v in zip(writers, values, strict=True))
            held.append(values if self.form == "Native" else encoded)
            size += len(encoded)
            if len(held) >= self.batch.max_rows or size >= self.batch.max_bytes:
                yield len(held), "rows" if len(held) >= self.batch.max_rows else "bytes", self._body(held)
                held, size = [], 0
        if held:
            yield len(held), "drain", self._body(held)

    def _body(self, held: list) -> bytes:
        return encoders.block(self.columns, held) if self.form == "Native" else b"".join(held)

    def writer(self, shard: str = "shard") -> Writer:
        """A writer for streaming.runtime: rows carry their shard number, and go out in the order of their columns, so that a
        replayed batch is sealed alike and its inserts have their first tokens."""
        sink = self

        def write(df: DataFrame, batch: int) -> None:
            def partition(rows) -> None:
                for s, part in groupby(rows, key=lambda r: r[shard]):
                    for n, (_, _, body) in enumerate(sink.bodies(part)):
                        settings = sink.settings | {"insert_deduplicate": "1", "wait_end_of_query": "1", "insert_deduplication_token": f"{sink.pipeline}-{sink.run}-{s}-{batch}" + (f"-{n}" if n else "")}
                        try:
                            sink.send(sink.endpoints[s], sink.statement, settings, body)
                        except Exception as e:
                            if classify(str(e)) == "fatal":
                                raise FatalWriteError(str(e)) from e
                            raise

            order = [c for c in df.columns if c != shard and df.schema[c].dataType.typeName() not in ("map", "variant")]
            df.repartition(len(sink.endpoints), shard).sortWithinPartitions(shard, *order).foreachPartition(partition)

        return write
