"""Bounded backfills from object stores: listing, planning into splits, reading records with positions, resuming."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.objects import RECORD_BITS, Entry, pack, split_id


class PoisonedSplit(RuntimeError):
    """A split that no retry mends; `reason` is not_found, etag_drift, undecodable or retries_exhausted."""

    def __init__(self, reason: str, detail: str) -> None:
        super().__init__(f"{reason}: {detail}")
        self.reason = reason


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """key, size and etag (modification time and length) of the objects below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.concat_ws("-", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string")).alias("etag"))


@dataclass(frozen=True)
class Split:
    ident: str
    objects: tuple[Entry, ...]


def plan(entries: list[Entry], target: int) -> list[Split]:
    """A planner's fold over a listing in key order."""
    return [Split(split_id(s), tuple(s)) for s in pack(sorted(entries, key=lambda e: e.key), target)]


def _decoded(data: bytes, key: str, codec: str) -> Iterator[bytes]:
    low = key.lower()
    kind = codec if codec != "auto" else "gzip" if low.endswith((".gz", ".gzip")) else "zstd" if low.endswith((".zst", ".zstd")) else "none"
    try:
        if kind == "gzip":
            yield from gzip.GzipFile(fileobj=io.BytesIO(data))
        elif kind == "zstd":
            import zstandard

            yield from io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True))
        else:
            yield from io.BytesIO(data)
    except Exception as e:
        raise PoisonedSplit("undecodable", f"{key}: {e}") from None


def records(data: bytes, key: str, codec: str = "auto", max_bytes: int | None = None) -> Iterator[bytes]:
    """Lines of an object: one carriage return at the end dropped, white space lines left out without a number."""
    for line in _decoded(data, key, codec):
        line = line[:-1] if line.endswith(b"\n") else line
        line = line[:-1] if line.endswith(b"\r") else line
        if max_bytes is not None and len(line) > max_bytes:
            raise PoisonedSplit("undecodable", f"{key}: a record of {len(line)} bytes")
        if line.strip(b" \t\n\f\r"):
            yield line


def read_splits(spark: SparkSession, splits: DataFrame, path: str, codec: str = "auto", pattern: str = "*", max_bytes: int | None = None) -> DataFrame:
    """value, split, offset (composite: object ordinal and record number) for rows (split, ordinal, key, from_record)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")
    rows = splits.join(files, F.col("key") == F.col("path")).select("split", "ordinal", "key", "from_record", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for s, o, k, start, data in pdf.itertuples(index=False):
                out = [(v, s, (int(o) << RECORD_BITS) + i) for i, v in enumerate(records(bytes(data), k, codec, max_bytes)) if i >= start]
                if out:
                    yield pd.DataFrame(out, columns=["value", "split", "offset"])

    return rows.mapInPandas(run, "value binary, split string, offset long")


def resume_point(split: Split, watermark: int, seen: dict[int, tuple[str, str]]) -> tuple[int, int]:
    """(ordinal, record) to go on from. `seen` has the key and etag noted at an ordinal: both must still hold, and an
    object without an etag can't be continued in its middle."""
    ordinal, record = watermark >> RECORD_BITS, watermark & (1 << RECORD_BITS) - 1
    if ordinal >= len(split.objects):
        if ordinal == len(split.objects) and record == 0:
            return ordinal, 0
        raise PoisonedSplit("not_found", f"no object {ordinal} in {split.ident}")
    now = split.objects[ordinal]
    if ordinal in seen:
        key, etag = seen[ordinal]
        if key != now.key:
            raise PoisonedSplit("not_found", f"{key} is now {now.key}")
        if etag != now.etag:
            raise PoisonedSplit("etag_drift", key)
    if record and not now.etag:
        raise PoisonedSplit("etag_drift", f"{now.key} has no etag")
    return ordinal, record
