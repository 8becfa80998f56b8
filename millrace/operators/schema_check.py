"""Target-table checks: a column-type parser, comparison of a DataFrame's schema with a table, and of shard layouts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

OFF, NAMES, FULL = "off", "names", "full"
_SIMPLE = {
    "Bool": T.BooleanType(), "Int8": T.ByteType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(), "UInt8": T.ShortType(), "UInt16": T.IntegerType(), "UInt32": T.LongType(),
    "UInt64": T.DecimalType(20, 0), "Int128": T.DecimalType(38, 0), "UInt128": T.DecimalType(38, 0), "Int256": T.BinaryType(), "UInt256": T.BinaryType(), "Float32": T.FloatType(), "Float64": T.DoubleType(),
    "String": T.StringType(), "Date": T.DateType(), "Date32": T.DateType(), "UUID": T.StringType(), "IPv4": T.LongType(), "IPv6": T.BinaryType(), "Time": T.DayTimeIntervalType(), "JSON": T.VariantType(),
}
_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_GEO = {"Point": 0, "Ring": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


@dataclass(frozen=True)
class ColumnType:
    """A parsed type: its constructor, arguments (types, numbers or strings), and element names of tuples."""

    name: str
    args: tuple = ()
    labels: tuple[str, ...] = ()

    @property
    def nullable(self) -> bool:
        return self.name == "Nullable" or self.name == "LowCardinality" and self.args[0].nullable

    def spark(self) -> T.DataType | None:
        """The Spark type that holds it, or None where any is accepted."""
        n, a = self.name, self.args
        if n in _SIMPLE:
            return _SIMPLE[n]
        if n in _GEO:
            out: T.DataType = _POINT
            for _ in range(_GEO[n]):
                out = T.ArrayType(out)
            return out
        if n in ("Nullable", "LowCardinality"):
            return a[0].spark()
        if n == "SimpleAggregateFunction":
            return a[1].spark()
        if n == "Array":
            item = a[0].spark()
            return T.ArrayType(item) if item is not None else None
        if n == "Map":
            k, v = a[0].spark(), a[1].spark()
            return T.MapType(k, v) if k is not None and v is not None else None
        if n == "Tuple":
            kinds = [x.spark() for x in a]
            if None in kinds:
                return None
            return T.StructType([T.StructField(self.labels[i] if self.labels else f"_{i + 1}", k) for i, k in enumerate(kinds)])
        if n == "FixedString" or n in ("Enum8", "Enum16"):
            return T.StringType()
        if n == "DateTime":
            return T.TimestampType()
        if n == "DateTime64":
            return T.LongType() if a[0] > 6 else T.TimestampType()
        if n == "Time64":
            return T.DayTimeIntervalType()
        if n == "Decimal":
            return T.DecimalType(*a) if a[0] <= 38 else T.BinaryType()
        return None


def _split(text: str) -> list[str] | None:
    """Arguments at the top level: commas inside parentheses and quotes do not cut."""
    out, depth, quote, at, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                return None
        elif c == "," and not depth:
            out.append(text[at:i].strip())
            at = i + 1
        i += 1
    if depth or quote:
        return None
    out.append(text[at:].strip())
    return out if all(out) else None


def _unquoted(text: str) -> str:
    if len(text) < 2 or text[0] != "'" or text[-1] != "'":
        raise ValueError(text)
    return text[1:-1]


def parse_type(text: str) -> ColumnType:
    """Never fails: what the grammar does not know becomes Other, which is compatible with everything."""
    text = text.strip()
    try:
        return _parse(text)
    except (ValueError, KeyError, IndexError):
        return ColumnType("Other", (text,))


def _parse(text: str) -> ColumnType:
    name, paren, rest = text.partition("(")
    name = name.strip()
    if not name or not all(c.isascii() and (c.isalnum() or c == "_") for c in name) or paren and not text.endswith(")"):
        raise ValueError(text)
    args = _split(rest[:-1]) if paren else []
    if args is None:
        raise ValueError(text)
    many = {"Nullable": 1, "LowCardinality": 1, "Array": 1, "Map": 2}
    if name in many and len(args) == many[name]:
        return ColumnType(name, tuple(parse_type(x) for x in args))
    if name == "Tuple" and args:
        kinds, labels = [], []
        for x in args:
            head, space, tail = x.partition(" ")
            named = bool(space) and "(" not in head and "'" not in head
            labels.append(head.strip("`") if named else "")
            kinds.append(parse_type(tail if named else x))
        return ColumnType(name, tuple(kinds), tuple(labels) if all(labels) else ())
    if name == "SimpleAggregateFunction" and len(args) == 2:
        return ColumnType(name, (args[0], parse_type(args[1])))
    if name in ("FixedString", "Time64") and len(args) == 1:
        return ColumnType(name, (int(args[0]),))
    if name == "DateTime" and len(args) <= 1:
        return ColumnType(name, tuple(_unquoted(x) for x in args))
    if name == "DateTime64" and 1 <= len(args) <= 2:
        return ColumnType(name, (int(args[0]), *[_unquoted(x) for x in args[1:]]))
    if name == "Decimal" and len(args) == 2:
        return ColumnType(name, (int(args[0]), int(args[1])))
    widths = {"Decimal32": 9, "Decimal64": 18, "Decimal128": 38, "Decimal256": 76}
    if name in widths and len(args) == 1:
        return ColumnType("Decimal", (widths[name], int(args[0])))
    if name in ("Enum8", "Enum16"):
        return ColumnType(name)
    if not args:
        return ColumnType(name)
    raise ValueError(text)


@dataclass(frozen=True)
class TargetColumn:
    name: str
    type: str
    default_kind: str = ""  # DEFAULT, MATERIALIZED, ALIAS or none


@dataclass
class Findings:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def validate(schema: T.StructType, target: list[TargetColumn], mode: str = FULL) -> Findings:
    """What keeps rows of this schema from being inserted into the target."""
    out = Findings()
    if mode == OFF:
        return out
    if mode not in (NAMES, FULL):
        raise ValueError(f"mode is {mode!r}, not off, names or full")
    table = {c.name: c for c in target}
    for f in schema.fields:
        c = table.get(f.name)
        if c is None:
            out.errors.append(f"{f.name}: not in the table")
            continue
        if c.default_kind in ("MATERIALIZED", "ALIAS"):
            out.errors.append(f"{f.name}: {c.default_kind} columns can't be written")
            continue
        if c.type.startswith("AggregateFunction("):
            out.errors.append(f"{f.name}: aggregate states can't be written; write plain values and aggregate there")
            continue
        if mode == FULL:
            kind = parse_type(c.type)
            want = kind.spark()
            if want is not None and not _same(f.dataType, want):
                out.errors.append(f"{f.name}: {f.dataType.simpleString()} does not fit {c.type} ({want.simpleString()})")
            elif f.nullable != kind.nullable and want is not None and not isinstance(want, (T.ArrayType, T.MapType)):
                out.errors.append(f"{f.name}: {'nullable' if f.nullable else 'not nullable'}, but the table has {c.type}")
    given = {f.name for f in schema.fields}
    out.warnings += [f"{c.name}: not written and without a default" for c in target if c.name not in given and not c.default_kind and not parse_type(c.type).nullable]
    return out


def _same(a: T.DataType, b: T.DataType) -> bool:
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return len(a) == len(b) and all(_same(x.dataType, y.dataType) for x, y in zip(a, b, strict=True))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return _same(a.elementType, b.elementType)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return _same(a.keyType, b.keyType) and _same(a.valueType, b.valueType)
    if isinstance(a, T.BooleanType):
        return isinstance(b, (T.BooleanType, T.ShortType, T.ByteType))
    return a == b


def same_on_all(replicas: list[list[TargetColumn]]) -> list[str]:
    """Replicas whose columns differ from the first one's."""
    return [f"replica {i}: its columns differ from those of replica 0" for i, r in enumerate(replicas) if r != replicas[0]]


def check_layout(shards: list[int], expression: str, cluster: list[int], engine: str, name: str | None = None) -> list[str]:
    """Whether our shards (weights in order) and sharding expression place rows as the distributed table does. `cluster`
    has its shards' weights, `engine` its full engine text; `name`: the cluster that the engine must name."""
    out = []
    if len(shards) != len(cluster):
        out.append(f"{len(shards)} shards here, {len(cluster)} in the cluster")
    elif shards != cluster:
        out.append(f"weights {shards} here, {cluster} in the cluster")
    args = _split(engine[engine.index("(") + 1 : engine.rindex(")")]) if engine.startswith("Distributed(") and engine.rstrip().endswith(")") else None
    if name is not None and args and args[0].strip().strip("'`\"") != name:
        out.append(f"cluster {name} here, {args[0].strip().strip(chr(39))} there")
    if not args or len(args) < 4:
        out.append("the table has no sharding expression")
    elif _plain(args[3]) != _plain(expression):
        out.append(f"sharding by {expression} here, by {args[3]} there")
    return out


def _plain(expression: str) -> str:
    return "".join(expression.replace("`", "").replace('"', "").split()).lower()
