"""Avro without external jars: wire framings, a datum decoder with schema resolution, an encoder, a schema cache.

Decoding runs in Arrow batches; the reader's plan is built once for each schema and worker.
"""

from __future__ import annotations

import json
import struct
import time
from collections.abc import Callable
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH, MIN_ITEMS = 128, 65_536
PRIMITIVES = {"null", "boolean", "int", "long", "float", "double", "bytes", "string"}
#: Promotions that schema resolution allows, writer to readers.
PROMOTE = {"int": {"long", "float", "double"}, "long": {"float", "double"}, "float": {"double"}, "string": {"bytes"}, "bytes": {"string"}}
RABIN_EMPTY = 0xC15D213AA4D7A795


class AvroError(ValueError):
    """A payload that does not follow its schema."""


class SchemaUnavailable(AvroError):
    """No schema is known for a payload's id or fingerprint."""


def _rabin_table() -> list[int]:
    out = []
    for i in range(256):
        f = i
        for _ in range(8):
            f = (f >> 1) ^ (RABIN_EMPTY if f & 1 else 0)
        out.append(f)
    return out


_RABIN = _rabin_table()


def rabin(data: bytes) -> int:
    """CRC-64-AVRO."""
    f = RABIN_EMPTY
    for b in data:
        f = (f >> 8) ^ _RABIN[(f ^ b) & 0xFF]
    return f


def canonical(schema: object, space: str = "") -> str:
    """Parsing canonical form."""
    if isinstance(schema, str):
        return json.dumps(schema if schema in PRIMITIVES or "." in schema or not space else f"{space}.{schema}")
    if isinstance(schema, list):
        return "[" + ",".join(canonical(s, space) for s in schema) + "]"
    kind = schema["type"]
    if kind in PRIMITIVES:
        return json.dumps(kind)
    if not isinstance(kind, str):
        return canonical(kind, space)
    parts = []
    if kind in ("record", "enum", "fixed"):
        name = schema["name"]
        space = name.rpartition(".")[0] if "." in name else schema.get("namespace", space)
        parts.append(f'"name":{json.dumps(name if "." in name or not space else f"{space}.{name}")}')
    parts.append(f'"type":{json.dumps(kind)}')
    if kind == "record":
        parts.append('"fields":[' + ",".join(f'{{"name":{json.dumps(f["name"])},"type":{canonical(f["type"], space)}}}' for f in schema["fields"]) + "]")
    elif kind == "enum":
        parts.append('"symbols":' + json.dumps(schema["symbols"], separators=(",", ":")))
    elif kind == "array":
        parts.append('"items":' + canonical(schema["items"], space))
    elif kind == "map":
        parts.append('"values":' + canonical(schema["values"], space))
    elif kind == "fixed":
        parts.append(f'"size":{int(schema["size"])}')
    return "{" + ",".join(parts) + "}"


def fingerprint(schema: object) -> int:
    return rabin(canonical(schema).encode())


def confluent_id(value: Column) -> Column:
    """The schema id of a registry-framed payload (0x00, 4 bytes big-endian); null for another start or a short payload."""
    ok = (F.octet_length(value) >= 5) & (F.hex(F.substring(value, 1, 1)) == "00")
    return F.when(ok, F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("long"))


def confluent_datum(value: Column) -> Column:
    return F.substring(value, F.lit(6), F.greatest(F.octet_length(value) - 5, F.lit(0)))


def single_object_fingerprint(value: Column) -> Column:
    """The fingerprint of a single-object payload (C3 01, 8 bytes little-endian) as 16 hex digits, or null."""
    h = F.hex(F.substring(value, 3, 8))
    ok = (F.octet_length(value) >= 10) & (F.hex(F.substring(value, 1, 2)) == "C301")
    return F.when(ok, F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)]))


class _Cursor:
    __slots__ = ("at", "data", "items")

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.items = data, 0, max(len(data), MIN_ITEMS)

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise AvroError("the datum is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        shift = value = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            if b < 0x80:
                break
            shift += 7
            if shift > 63:
                raise AvroError("a number of more than ten bytes")
        return (value >> 1) ^ -(value & 1)

    def block(self) -> int:
        n = self.long()
        if n < 0:
            self.long()
            n = -n
        self.items -= n
        if self.items < 0:
            raise AvroError("more items than the payload could hold")
        return n


Reader = Callable[[_Cursor], object]


class Codec:
    """Readers and writers of one writer schema, resolved against an optional reader schema. Field aliases are not applied."""

    def __init__(self, writer: object, reader: object | None = None) -> None:
        self.names: dict[str, object] = {}
        self.reader_names: dict[str, object] = {}
        self.writer = self._named(writer, self.names)
        self.read = self._plan(self.writer, self._named(reader, self.reader_names) if reader is not None else None, 0)

    def _named(self, s: object, names: dict[str, object]) -> object:
        if isinstance(s, dict):
            if s.get("type") in ("record", "enum", "fixed"):
                names[s["name"].rpartition(".")[2]] = s
            for f in s.get("fields", ()):
                self._named(f["type"], names)
            for k in ("items", "values", "type"):
                if isinstance(s.get(k), (dict, list)):
                    self._named(s[k], names)
        elif isinstance(s, list):
            for x in s:
                self._named(x, names)
        return s

    @staticmethod
    def _open(s: object, names: dict[str, object]) -> object:
        while True:
            if isinstance(s, str) and s not in PRIMITIVES:
                s = names[s.rpartition(".")[2]]
            elif isinstance(s, dict) and isinstance(s["type"], (dict, list)):
                s = s["type"]
            else:
                return s

    @staticmethod
    def _kind(s: object) -> str:
        return s if isinstance(s, str) else "union" if isinstance(s, list) else s["type"]

    def _plan(self, w: object, r: object | None, depth: int) -> Reader:
        if depth > MAX_DEPTH:
            raise AvroError("the schema is nested too deeply")
        w = self._open(w, self.names)
        r = self._open(r, self.reader_names) if r is not None else None
        kind = self._kind(w)
        if kind == "union":
            plans = [self._plan(b, r, depth + 1) if r is None or self._match(b, r) else None for b in w]

            def union(c: _Cursor) -> object:
                i = c.long()
                if not 0 <= i < len(plans):
                    raise AvroError("a union branch that the schema has not")
                if plans[i] is None:
                    raise AvroError("the reader has no type for this union branch")
                return plans[i](c)

            return union
        if isinstance(r, list):
            r = next((b for b in r if self._kind(self._open(b, self.reader_names)) == kind), None) or next((b for b in r if self._match(w, b)), None)
            if r is None:
                raise AvroError(f"the reader's union has no type for {kind}")
            return self._plan(w, r, depth + 1)
        if r is not None and not self._match(w, r):
            raise AvroError(f"{kind} can't be read as {self._kind(r)}")
        to = self._kind(r) if r is not None else kind
        if kind == "record":
            return self._record(w, r, depth)
        if kind == "array":
            item = self._plan(w["items"], r["items"] if r else None, depth + 1)

            def array(c: _Cursor) -> list:
                out: list = []
                while n := c.block():
                    out += [item(c) for _ in range(n)]
                return out

            return array
        if kind == "map":
            value = self._plan(w["values"], r["values"] if r else None, depth + 1)

            def mapping(c: _Cursor) -> dict:
                out: dict = {}
                while n := c.block():
                    for _ in range(n):
                        k = c.take(c.long()).decode()
                        out[k] = value(c)
                return out

            return mapping
        if kind == "enum":
            symbols = w["symbols"]

            def enum(c: _Cursor) -> str:
                i = c.long()
                if not 0 <= i < len(symbols):
                    raise AvroError("an enum index that the schema has not")
                return symbols[i]

            return enum
        logical = w.get("logicalType") if isinstance(w, dict) else None
        if logical in ("duration", "big-decimal"):
            raise AvroError(f"logical type {logical} is not supported")
        if logical == "decimal":
            scale = int(w.get("scale", 0))
            raw = (lambda c: c.take(int(w["size"]))) if kind == "fixed" else (lambda c: c.take(c.long()))
            return lambda c: Decimal(int.from_bytes(raw(c), "big", signed=True)).scaleb(-scale)
        if kind == "fixed":
            return lambda c: c.take(int(w["size"]))
        return self._primitive(kind, to)

    def _record(self, w: dict, r: dict | None, depth: int) -> Reader:
        own = {f["name"]: f for f in r["fields"]} if r else None
        steps = []
        for f in w["fields"]:
            keep = own is None or f["name"] in own
            steps.append((f["name"], self._plan(f["type"], own[f["name"]]["type"] if own and keep else None, depth + 1), keep))
        fill = {}
        for n, f in (own or {}).items():
            if n not in {x["name"] for x in w["fields"]}:
                if "default" not in f:
                    raise AvroError(f"field {n} has neither a writer nor a default")
                fill[n] = f["default"]

        def record(c: _Cursor) -> dict:
            out = dict(fill)
            for name, step, keep in steps:
                v = step(c)
                if keep:
                    out[name] = v
            return out

        return record

    def _match(self, w: object, r: object) -> bool:
        w, r = self._open(w, self.names), self._open(r, self.reader_names)
        if isinstance(r, list):
            return any(self._match(w, b) for b in r)
        a, b = self._kind(w), self._kind(r)
        return a == b or b in PROMOTE.get(a, ())

    @staticmethod
    def _primitive(kind: str, to: str) -> Reader:
        if kind == "null":
            return lambda c: None
        if kind == "boolean":
            def boolean(c: _Cursor) -> bool:
                b = c.take(1)[0]
                if b > 1:
                    raise AvroError("a boolean that is neither 0 nor 1")
                return b == 1

            return boolean
        if kind in ("int", "long"):
            def number(c: _Cursor) -> object:
                v = c.long()
                if kind == "int" and not -(1 << 31) <= v < 1 << 31:
                    raise AvroError("an int beyond 32 bits")
                return float(v) if to in ("float", "double") else v

            return number
        if kind == "float":
            return lambda c: struct.unpack("<f", c.take(4))[0]
        if kind == "double":
            return lambda c: struct.unpack("<d", c.take(8))[0]
        if to == "string":
            return lambda c: c.take(c.long()).decode()
        return lambda c: c.take(c.long())

    def decode(self, data: bytes) -> object:
        c = _Cursor(data)
        out = self.read(c)
        if c.at != len(data):
            raise AvroError("bytes remain after the datum")
        return out


def write_long(n: int) -> bytes:
    z, out = (n << 1) ^ (n >> 63), bytearray()
    while z > 0x7F:
        out.append(z & 0x7F | 0x80)
        z >>= 7
    out.append(z)
    return bytes(out)


def encode(schema: object, value: object, names: dict[str, object] | None = None) -> bytes:
    """A bare datum. In unions the first branch that fits is taken; a record goes to the branch named by its `_type`."""
    names = {} if names is None else names
    if isinstance(schema, str) and schema not in PRIMITIVES:
        schema = names[schema.rpartition(".")[2]]
    if isinstance(schema, list):
        i = next(i for i, b in enumerate(schema) if _fits(b, value))
        return write_long(i) + encode(schema[i], value, names)
    kind = schema if isinstance(schema, str) else schema["type"]
    if isinstance(kind, (dict, list)):
        return encode(kind, value, names)
    if kind in ("record", "enum", "fixed"):
        names[schema["name"].rpartition(".")[2]] = schema
    if kind == "null":
        return b""
    if kind == "boolean":
        return b"\1" if value else b"\0"
    if kind in ("int", "long"):
        return write_long(int(value))
    if kind == "float":
        return struct.pack("<f", value)
    if kind == "double":
        return struct.pack("<d", value)
    if kind in ("bytes", "string"):
        raw = value.encode() if isinstance(value, str) else bytes(value)
        return write_long(len(raw)) + raw
    if kind == "fixed":
        return bytes(value)
    if kind == "enum":
        return write_long(schema["symbols"].index(value))
    if kind == "array":
        return (write_long(len(value)) + b"".join(encode(schema["items"], v, names) for v in value) if value else b"") + b"\0"
    if kind == "map":
        return (write_long(len(value)) + b"".join(encode("string", k) + encode(schema["values"], v, names) for k, v in value.items()) if value else b"") + b"\0"
    return b"".join(encode(f["type"], value[f["name"]], names) for f in schema["fields"])


def _fits(branch: object, value: object) -> bool:
    kind = branch if isinstance(branch, str) else branch["type"]
    if value is None:
        return kind == "null"
    if isinstance(value, dict):
        return kind == "record" and value.get("_type", branch["name"]) == branch["name"] or kind == "map" and "_type" not in value
    if isinstance(value, bool):
        return kind == "boolean"
    return kind in {int: ("int", "long"), float: ("double", "float"), str: ("string", "enum"), bytes: ("bytes", "fixed"), list: ("array",)}.get(type(value), ())


class SchemaCache:
    """Schemas by id. Only permanent failures are remembered, and only for a while; a known schema is never lost."""

    def __init__(self, fetch: Callable[[int], object], negative_ttl: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.fetch, self.ttl, self.clock = fetch, negative_ttl, clock
        self.ready: dict[int, object] = {}
        self.gone: dict[int, float] = {}

    def get(self, ident: int) -> object | None:
        """The schema; None while it can't be had (try again); SchemaUnavailable when it does not exist."""
        if ident in self.ready:
            return self.ready[ident]
        if self.gone.get(ident, 0) > self.clock():
            raise SchemaUnavailable(f"schema {ident} does not exist")
        self.gone.pop(ident, None)
        try:
            self.ready[ident] = self.fetch(ident)
        except KeyError:
            self.gone[ident] = self.clock() + self.ttl
            raise SchemaUnavailable(f"schema {ident} does not exist") from None
        except OSError:
            return None
        return self.ready[ident]


def decode_column(value: Column, writer: object, kind: str | T.DataType, reader: object | None = None, errors: str = "skip") -> Column:
    """A struct column of bare datums. skip: a bad datum is null; fail: it stops the query."""
    ddl = kind if isinstance(kind, str) else kind.simpleString()
    arrow = _arrow(ddl)

    @F.arrow_udf(ddl)
    def run(data: pa.Array) -> pa.Array:
        codec = Codec(writer, reader)
        out = []
        for d in data.to_pylist():
            try:
                out.append(codec.decode(d) if d is not None else None)
            except (AvroError, UnicodeDecodeError):
                if errors == "fail":
                    raise
                out.append(None)
        return pa.array(out, arrow)

    return run(value)


def _arrow(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(T.DataType.fromDDL(ddl))


def encode_column(value: Column, schema: object) -> Column:
    """Bare datums of a struct column."""

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([encode(schema, r) if r is not None else None for r in rows.to_pylist()], pa.binary())

    return run(value)
