"""Scripted payloads as a source, for tests: rows pushed lane by lane, read as a batch or a stream."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .datagen import ENVELOPE


def script(lanes: dict[int, list[tuple[bytes | None, bytes | None]]]) -> str:
    """The `lanes` option: (value, key) of each lane's records in order."""
    enc = lambda b: None if b is None else base64.b64encode(b).decode()
    return json.dumps({str(k): [[enc(v), enc(x)] for v, x in rows] for k, rows in lanes.items()})


class _Part(InputPartition):
    def __init__(self, lane: int, rows: list, start: int) -> None:
        self.lane, self.rows, self.start = lane, rows, start


def _read(p: _Part) -> Iterator[tuple]:
    dec = lambda s: None if s is None else base64.b64decode(s)
    for i, (v, k) in enumerate(p.rows):
        yield dec(v) or b"", dec(k), p.lane, p.start + i, 0


class _Batch(DataSourceReader):
    def __init__(self, lanes: dict) -> None:
        self.lanes = lanes

    def partitions(self) -> list[_Part]:
        return [_Part(int(k), rows, 0) for k, rows in self.lanes.items()]

    def read(self, p: _Part) -> Iterator[tuple]:
        return _read(p)


class _Stream(DataSourceStreamReader):
    def __init__(self, lanes: dict, step: int) -> None:
        self.lanes, self.step, self.at = lanes, step, None

    def initialOffset(self) -> dict:
        return {k: 0 for k in self.lanes}

    def latestOffset(self) -> dict:
        now = self.at or self.initialOffset()
        self.at = {k: min(len(self.lanes[k]), n + self.step) for k, n in now.items()}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return [_Part(int(k), self.lanes[k][start[k] : end[k]], start[k]) for k in end if end[k] > start[k]]

    def read(self, p: _Part) -> Iterator[tuple]:
        return _read(p)


class LanesSource(DataSource):
    """spark.dataSource.register(LanesSource); format("lanes").option("lanes", script({...})).option("step", n)."""

    @classmethod
    def name(cls) -> str:
        return "lanes"

    def schema(self) -> str:
        return ENVELOPE

    def reader(self, schema) -> DataSourceReader:
        return _Batch(json.loads(self.options["lanes"]))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(json.loads(self.options["lanes"]), int(self.options.get("step", "1000000")))
