"""Helpers for Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with about `limit` characters each, and their texts (null: empty); a longer text stands alone."""
    for batch in batches:
        texts = batch.column(text).to_pylist()
        at, size = 0, 0
        for i, t in enumerate(texts):
            n = len(t) if t else 0
            if i > at and size + n > limit:
                yield batch.slice(at, i - at), [x or "" for x in texts[at:i]]
                at, size = i, 0
            size += n
        if at < len(texts):
            yield batch.slice(at), [x or "" for x in texts[at:]]
