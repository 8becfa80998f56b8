"""Row and column encoders of the warehouse's binary formats, driven by a target's column types.

Rows become bytes in Arrow batches; a value that does not fit its column is an EncodeError, which a policy skips (the row
leaves no partial bytes) or lets stop the query.
"""

from __future__ import annotations

import datetime as dt
import ipaddress
import struct
import uuid
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema_check import ColumnType, TargetColumn, parse_type

_FIXED = {"Int8": "<b", "UInt8": "<B", "Int16": "<h", "UInt16": "<H", "Int32": "<i", "UInt32": "<I", "Int64": "<q", "UInt64": "<Q", "Float32": "<f", "Float64": "<d"}
_WIDE = {"Int128": (16, True), "UInt128": (16, False), "Int256": (32, True), "UInt256": (32, False)}
_GEO = {"Ring": "Point", "LineString": "Point", "Polygon": "Ring", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}
_EPOCH = dt.date(1970, 1, 1)


class EncodeError(ValueError):
    """A value that its column can't hold."""


def leb(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _micros(v: object) -> int:
    if isinstance(v, dt.datetime):
        v = v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
        d = v - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
        return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds
    raise EncodeError(f"{v!r} is no timestamp")


def _leaf(t: ColumnType) -> Callable[[object], bytes] | None:
    """The writer of a type without parts; RowBinary and the column format share it."""
    n = t.name
    if n in _FIXED:
        return lambda v: struct.pack(_FIXED[n], v)
    if n == "Bool":
        return lambda v: b"\1" if v else b"\0"
    if n in _WIDE:
        size, signed = _WIDE[n]

        def wide(v: object) -> bytes:
            if isinstance(v, (bytes, bytearray)):
                if len(v) != size:
                    raise EncodeError(f"{n} takes {size} bytes")
                return bytes(v)
            return int(v).to_bytes(size, "little", signed=signed)

        return wide
    if n in ("String", "JSON"):
        def text(v: object) -> bytes:
            b = v.encode() if isinstance(v, str) else bytes(v)
            return leb(len(b)) + b

        return text
    if n == "FixedString":
        size = t.args[0]

        def fixed(v: object) -> bytes:
            b = v.encode() if isinstance(v, str) else bytes(v)
            if len(b) > size:
                raise EncodeError(f"{len(b)} bytes in a FixedString({size})")
            return b.ljust(size, b"\0")

        return fixed
    if n in ("Date", "Date32"):
        return lambda v: struct.pack("<H" if n == "Date" else "<i", (v - _EPOCH).days if isinstance(v, dt.date) else v)
    if n == "DateTime":
        return lambda v: struct.pack("<I", _micros(v) // 1_000_000 if isinstance(v, dt.datetime) else v)
    if n in ("DateTime64", "Time64"):
        p = t.args[0]
        return lambda v: struct.pack("<q", (_micros(v) if isinstance(v, dt.datetime) else v // dt.timedelta(microseconds=1)) * 10**p // 1_000_000 if isinstance(v, (dt.datetime, dt.timedelta)) else v)
    if n == "Time":
        return lambda v: struct.pack("<i", int(v.total_seconds()) if isinstance(v, dt.timedelta) else v)
    if n == "Decimal":
        p, scale = t.args
        size = 4 if p <= 9 else 8 if p <= 18 else 16 if p <= 38 else 32

        def decimal(v: object) -> bytes:
            q = int(Decimal(v).scaleb(scale).to_integral_value(ROUND_HALF_UP))
            if abs(q) >= 10**p:
                raise EncodeError(f"{v} does not fit Decimal({p}, {scale})")
            return q.to_bytes(size, "little", signed=True)

        return decimal
    if n == "UUID":
        def ident(v: object) -> bytes:
            b = uuid.UUID(str(v)).bytes
            return b[7::-1] + b[:7:-1]

        return ident
    if n == "IPv4":
        return lambda v: struct.pack("<I", int(ipaddress.IPv4Address(v)))
    if n == "IPv6":
        return lambda v: ipaddress.IPv6Address(bytes(v) if isinstance(v, (bytes, bytearray)) else v).packed
    if n in ("Enum8", "Enum16"):
        return lambda v: struct.pack("<b" if n == "Enum8" else "<h", v)
    if n == "Point":
        return None
    return None


def _items(v: object) -> list:
    if isinstance(v, dict):
        return list(v.items())
    return list(v)


def _parts(v: object) -> list:
    return list(v.values()) if isinstance(v, dict) else list(v)


def _guard(write: Callable[[object], bytes]) -> Callable[[object], bytes]:
    def safe(v: object) -> bytes:
        try:
            return write(v)
        except EncodeError:
            raise
        except (TypeError, ValueError, ArithmeticError, struct.error, OverflowError, AttributeError) as e:
            raise EncodeError(str(e)) from None

    return safe


def row_writer(t: ColumnType) -> Callable[[object], bytes]:
    """RowBinary: values one after the other, lengths in front, a null byte in front of nullable values."""
    if t.name == "LowCardinality":
        return row_writer(t.args[0])
    if t.name == "SimpleAggregateFunction":
        return row_writer(t.args[1])
    if t.name == "Nullable":
        if t.args[0].name == "Nullable":
            raise EncodeError("a nullable type in a nullable type")
        inner = row_writer(t.args[0])
        return lambda v: b"\1" if v is None else b"\0" + inner(v)
    if t.name in _GEO:
        return row_writer(ColumnType("Array", (ColumnType(_GEO[t.name]),)))
    if t.name == "Point":
        return row_writer(ColumnType("Tuple", (ColumnType("Float64"), ColumnType("Float64"))))
    if t.name == "Array":
        item = row_writer(t.args[0])
        return _guard(lambda v: leb(len(v)) + b"".join(map(item, v)))
    if t.name == "Map":
        key, value = map(row_writer, t.args)
        return _guard(lambda v: leb(len(v)) + b"".join(key(k) + value(x) for k, x in _items(v)))
    if t.name == "Tuple":
        parts = [row_writer(x) for x in t.args]
        return _guard(lambda v: b"".join(w(x) for w, x in zip(parts, _parts(v), strict=True)))
    leaf = _leaf(t)
    if leaf is None:
        raise EncodeError(f"{t.name} can't be written")

    def write(v: object) -> bytes:
        if v is None:
            raise EncodeError(f"null in a {t.name} column")
        return leaf(v)

    return _guard(write)


def _default(t: ColumnType) -> object:
    """What stands at a null's place in a dense stream."""
    zero = {"String": "", "JSON": "{}", "FixedString": "", "UUID": "00000000-0000-0000-0000-000000000000", "IPv4": "0.0.0.0", "IPv6": "::", "Date": _EPOCH, "Date32": _EPOCH}
    if t.name in ("Array", "Map"):
        return []
    if t.name == "Tuple":
        return [_default(x) for x in t.args]
    if t.name == "LowCardinality":
        return _default(t.args[0])
    return zero.get(t.name, 0)


def column_bytes(t: ColumnType, values: list) -> bytes:
    """One column of a block: streams by kind."""
    if t.name == "SimpleAggregateFunction":
        return column_bytes(t.args[1], values)
    if t.name == "Nullable":
        filler = _default(t.args[0])
        return bytes(v is None for v in values) + column_bytes(t.args[0], [filler if v is None else v for v in values])
    if t.name in _GEO:
        return column_bytes(ColumnType("Array", (ColumnType(_GEO[t.name]),)), values)
    if t.name == "Point":
        return column_bytes(ColumnType("Tuple", (ColumnType("Float64"), ColumnType("Float64"))), values)
    if t.name in ("Array", "Map"):
        ends, flat = [], []
        for v in values:
            flat += _items(v)
            ends.append(len(flat))
        head = struct.pack(f"<{len(ends)}Q", *ends)
        if t.name == "Array":
            return head + column_bytes(t.args[0], flat)
        return head + column_bytes(t.args[0], [k for k, _ in flat]) + column_bytes(t.args[1], [x for _, x in flat])
    if t.name == "Tuple":
        rows = [_parts(v) for v in values]
        return b"".join(column_bytes(x, [r[i] for r in rows]) for i, x in enumerate(t.args))
    if t.name == "LowCardinality":
        return _dictionary(t.args[0], values)
    write = row_writer(t)
    return b"".join(map(write, values))


def _dictionary(t: ColumnType, values: list) -> bytes:
    """A dictionary for the block and keys of the least width; place 0 is the default, and null where the type allows it."""
    if not values:
        return b""
    nullable = t.name == "Nullable"
    inner = t.args[0] if nullable else t
    write = row_writer(inner)
    words = [write(_default(inner))] * (2 if nullable else 1)
    place = {} if nullable else {words[0]: 0}
    if nullable:
        place[words[0]] = 1
    keys = []
    for v in values:
        if v is None and nullable:
            keys.append(0)
            continue
        w = write(v)
        if w not in place:
            place[w] = len(words)
            words.append(w)
        keys.append(place[w])
    code = 0 if len(words) <= 1 << 8 else 1 if len(words) <= 1 << 16 else 2
    flags = code | 1 << 9 | 1 << 10  # additional keys, dictionary renewed for each block
    return struct.pack("<QQQ", 1, flags, len(words)) + b"".join(words) + struct.pack(f"<Q{len(keys)}{'BHI'[code]}", len(keys), *keys)


def block(columns: list[TargetColumn], rows: list) -> bytes:
    """A column-format block: counts, then for each column its name, type and streams."""
    out = leb(len(columns)) + leb(len(rows))
    for i, c in enumerate(columns):
        name, kind = c.name.encode(), c.type.encode()
        out += leb(len(name)) + name + leb(len(kind)) + kind
        out += column_bytes(parse_type(c.type), [_parts(r)[i] for r in rows])
    return out


def encode_rows(df: DataFrame, columns: list[TargetColumn], policy: str = "skip") -> Column:
    """RowBinary of each row, in the order of `columns`; skip: null for a row that does not fit."""
    types = [c.type for c in columns]

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        writers = [row_writer(parse_type(t)) for t in types]
        out = []
        for r in rows.to_pylist():
            try:
                out.append(b"".join(w(v) for w, v in zip(writers, r.values(), strict=True)))
            except EncodeError:
                if policy == "fail":
                    raise
                out.append(None)
        return pa.array(out, pa.binary())

    return run(F.struct(*[df[c.name] for c in columns]))
