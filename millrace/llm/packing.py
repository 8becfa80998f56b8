"""Best-fit decreasing packing with a segment tree over remaining capacities.

Documents become id sequences with an end id; only longer ones than the capacity are cut. Pieces of one length are
interchangeable, so the packing is decided on the histogram of lengths, which has at most `capacity` entries whatever
the input: lengths fall, each piece goes to the tightest open bin, found in logarithmic time as the leftmost capacity
of a segment tree that has an open bin. Bins with the same remaining capacity and filling history form groups, and
pieces of one length fill whole groups at a time, which is what placing them one by one does. The outcome is a list of
runs (length, ranks from, ranks to, bins from, ...), and each piece finds its place by its rank among its length.

Ranks come from counts by (length, bucket of the id's hash), so that one frequent length is ranked by many tasks.

Null texts are empty: one piece of the end id alone. Ids may repeat; repeated rows are packed each. An empty table
gives an empty result; other columns are ignored. Pieces of a length that rank by chance (equal ids) get distinct places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, caches
from .batches import slices
from .bpe import new_words, tokenizer
from .lineage import stage


class WordEncoder:
    """Encodes by blank-separated words. The tokenizer drops white space and never joins what a blank or line feed
    separates (its normalizer maps characters one by one or composes marks, which never follow a blank into one), so a
    text's ids are those of its words one after the other. Words that were not met before go to the tokenizer."""

    def __init__(self, path: str, limit: int = 1_200_000) -> None:
        self.tok, self.limit = tokenizer(path), limit
        self.ids: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = list(set().union(*split).difference(self.ids)) if split else []
        if len(self.ids) + len(new) > self.limit:
            self.ids = {}
            new = list(set().union(*split))
        new_words(self.tok, new, self.ids, True)
        return [b"".join(map(self.ids.__getitem__, s)) for s in split]


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _forget() -> None:
    word_encoder.cache_clear()
    bpe.tokenizer.cache_clear()


caches.register("packing", _forget)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """key, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.claim("packing")
        for part, texts in slices(batches, limit=2 << 20):
            which, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(word_encoder(path).encode(texts)):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[a : a + 4 * capacity]
                    which.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["key", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class CapacityTree:
    """For each remaining capacity whether an open bin has it; `tightest` finds the least one that is large enough."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.node = [False] * (2 * self.size)

    def put(self, at: int, has: bool) -> None:
        i = at + self.size
        self.node[i] = has
        while i > 1:
            i //= 2
            up = self.node[2 * i] or self.node[2 * i + 1]
            if self.node[i] == up:
                break
            self.node[i] = up

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.node[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.node[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.node[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank_from, rank_to, first_bin, per_bin, offset): the piece with rank r goes to bin
    first_bin + (r - rank_from) // per_bin at offset + (r - rank_from) % per_bin * length. Bins are numbered from 0."""
    tree = CapacityTree(capacity)
    groups: dict[int, list[tuple[int, int]]] = {}  # by remaining capacity: (first bin, bins)
    out, opened = [], 0

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            if not groups.setdefault(room, []):
                tree.put(room, True)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                room, first, bins = capacity, opened, -(-left // each)
                opened += bins
            else:
                each = room // length
                first, have = groups[room].pop()
                bins = min(have, -(-left // each))
                if bins < have:
                    groups[room].append((first + bins, have - bins))
                elif not groups[room]:
                    tree.put(room, False)
            placed = min(left, bins * each)
            out.append((length, rank, rank + placed, first, each, capacity - room))
            full = placed // each
            give(room - each * length, first, full)
            give(room - placed % each * length, first + full, bins - full)
            rank += placed
            left -= placed
    return out


def pack(pieces: DataFrame, capacity: int = 2048, rows_per_bucket: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to rows with key, piece and length."""
    spark = pieces.sparkSession
    held = stage(pieces, "pieces")
    histogram = {r["length"]: r["count"] for r in held.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = best_fit(histogram, capacity)
    buckets = max(1, -(-sum(histogram.values()) // rows_per_bucket))
    marked = held.withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)))
    counts = marked.groupBy("length", "bucket").count()
    base = counts.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).drop("count")
    small = len(histogram) * buckets <= 200_000  # rows that go along with the tasks; otherwise they are dealt
    marked = marked.join(F.broadcast(base) if small else base, ["length", "bucket"])
    ranked = marked.withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("key", "piece")) - 1)
    at: dict[int, tuple[list[int], list[tuple[int, int, int, int]]]] = {}
    for length, a, z, first_bin, each, offset in runs:  # runs are bounded by pairs of lengths and capacities
        ends, places = at.setdefault(length, ([], []))
        ends.append(z)
        places.append((a, first_bin, each, offset))
    table = spark.sparkContext.broadcast({k: (np.array(e), np.array(p)) for k, (e, p) in at.items()})

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        order = np.argsort(n, kind="stable")
        starts = np.flatnonzero(np.diff(n[order], prepend=-1))
        for own in np.split(order, starts[1:]) if len(n) else []:
            size = int(n[own[0]])
            ends, places = table.value[size]
            p = places[np.searchsorted(ends, r[own], side="right")]
            k = r[own] - p[:, 0]
            seq[own] = p[:, 1] + k // p[:, 2]
            off[own] = p[:, 3] + k % p[:, 2] * size
        return pa.StructArray.from_arrays([pa.array(seq), pa.array(off)], ["sequence_id", "offset"])

    return ranked.withColumn("place", place("length", "rank")).select("key", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
