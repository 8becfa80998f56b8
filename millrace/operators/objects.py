"""Bounded object-store backfills: packing objects into splits, split ids, composite offsets, codecs."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the record index, open bins looked at, and the least cost of an object as a part of the target.
RECORD_BITS, ORDINAL_BITS, OPEN_BINS, COST_PART = 40, 23, 10, 16


@dataclass(frozen=True)
class Entry:
    key: str
    size: int
    etag: str = ""


def pack(entries: Iterable[Entry], target: int) -> list[list[Entry]]:
    """Splits of objects in listing order: an object goes to the oldest open split with room; at most OPEN_BINS splits are
    open, the oldest closes when another is needed, and a split closes when its cost reaches the target."""
    if target < 1:
        raise ValueError("the target must be positive")
    out: list[tuple[int, list[Entry]]] = []
    open_: list[tuple[int, int, list[Entry]]] = []  # number, cost, entries
    made = 0
    for e in entries:
        cost = max(e.size, target // COST_PART, 1)
        at = next((i for i, (_, c, _) in enumerate(open_) if c + cost <= target), None)
        if at is None:
            if len(open_) == OPEN_BINS:
                n, _, items = open_.pop(0)
                out.append((n, items))
            open_.append((made, 0, []))
            made += 1
            at = len(open_) - 1
        n, c, items = open_[at]
        items.append(e)
        if c + cost >= target:
            open_.pop(at)
            out.append((n, items))
        else:
            open_[at] = (n, c + cost, items)
    out += [(n, items) for n, _, items in open_]
    return [items for _, items in sorted(out, key=lambda x: x[0])]


def split_id(entries: Iterable[Entry], version: int = 1) -> str:
    """A name from the split's objects alone, whatever their order."""
    h = hashlib.sha256(b"millrace-split\n" + struct.pack("<I", version))
    for e in sorted(entries, key=lambda e: (e.key, e.etag)):
        for part in (e.key.encode(), e.etag.encode()):
            h.update(struct.pack("<Q", len(part)) + part)
    return "s3-" + base64.urlsafe_b64encode(h.digest()[:16]).rstrip(b"=").decode()


def split_id_column(key: Column, etag: Column, version: int = 1) -> Column:
    """split_id of a single object, JVM-side."""
    def le(n: Column) -> Column:
        raw = F.lpad(F.hex(n.cast("long")), 16, "0")
        return F.unhex(F.concat(*[F.substring(raw, 15 - 2 * i, 2) for i in range(8)]))

    k, e = F.encode(key, "UTF-8"), F.encode(etag, "UTF-8")
    head = F.lit(bytearray(b"millrace-split\n" + struct.pack("<I", version)))
    digest = F.unhex(F.substring(F.sha2(F.concat(head, le(F.octet_length(key)), k, le(F.octet_length(etag)), e), 256), 1, 32))
    return F.concat(F.lit("s3-"), F.rtrim(F.translate(F.base64(digest), "+/=", "-_ ")))


def encode_offset(ordinal: Column, record: Column) -> Column:
    """ordinal * 2**40 + record; out of range is null."""
    ok = (ordinal >= 0) & (ordinal < 1 << ORDINAL_BITS) & (record >= 0) & (record < (1 << RECORD_BITS) - 1)
    return F.when(ok, F.shiftleft(ordinal.cast("long"), RECORD_BITS).bitwiseOR(record.cast("long")))


def decode_offset(offset: Column) -> Column:
    return F.struct(F.shiftright(offset, RECORD_BITS).alias("ordinal"), offset.bitwiseAND(F.lit((1 << RECORD_BITS) - 1)).alias("record"))


def codec(key: Column, forced: str = "auto") -> Column:
    """gzip, zstd or none, by extension unless forced."""
    if forced != "auto":
        return F.lit(forced)
    k = F.lower(key)
    return F.when(k.rlike(r"\.gz(ip)?$"), "gzip").when(k.rlike(r"\.zstd?$"), "zstd").otherwise("none")
