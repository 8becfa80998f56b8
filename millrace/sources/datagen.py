"""A seeded storefront event stream: orders, their payments, refunds. Each lane is a pure function of seed and lane.

`storefront` is a Python data source (batch and stream) with the envelope's columns. In a stream, lanes advance by a
quota for each tick.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MASK = (1 << 64) - 1
# Fixed values, which must equal the studied generator's for equal streams.
GAMMA = 0x9E3779B97F4A7C15
REGIONS = ("eu-west", "eu-north", "us-east", "us-west", "apac")
FAMILIES = ("KBD", "MSE", "MON", "HDS", "CAM", "DCK", "CBL", "STD")
UNIT_CENTS = (
    7900, 12900, 18900, 24900, 3500, 4900, 7900, 11900, 129000, 189000, 249000, 399000, 5900, 9900, 14900, 22900,
    6900, 10900, 15900, 21900, 8900, 13900, 19900, 27900, 900, 1400, 1900, 2400, 34900, 44900, 59900, 79900,
)
REASONS = ("damaged", "not_as_described", "late_delivery", "changed_mind", "duplicate_order")
CUSTOMERS, WAITING, PLACES_BELOW, CAPTURES_BELOW = 1024, 256, 60, 95
SKUS = tuple(f"{f}-{i:02d}" for f in FAMILIES for i in range(1, 5))

ENVELOPE = "value binary, key binary, partition int, offset bigint, event_time_ms bigint"
EVENT_DDL = "type string, order_id bigint, customer_id int, region string, placed_at bigint, lines array<struct<sku: string, qty: int, unit_cents: int>>, amount_cents bigint, reason string"
EVENT_SCHEMA = [
    {"type": "record", "name": "OrderPlaced", "fields": [{"name": "order_id", "type": "long"}, {"name": "customer_id", "type": "int"}, {"name": "region", "type": "string"}, {"name": "placed_at", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "lines", "type": {"type": "array", "items": {"type": "record", "name": "OrderLine", "fields": [{"name": "sku", "type": "string"}, {"name": "qty", "type": "int"}, {"name": "unit_cents", "type": "int"}]}}}]},
    {"type": "record", "name": "PaymentCaptured", "fields": [{"name": "order_id", "type": "long"}, {"name": "amount_cents", "type": "long"}]},
    {"type": "record", "name": "RefundIssued", "fields": [{"name": "order_id", "type": "long"}, {"name": "amount_cents", "type": "long"}, {"name": "reason", "type": "string"}]},
]


class Draws:
    """The SplitMix64 stream of a seed."""

    def __init__(self, seed: int) -> None:
        self.state = seed & MASK

    def bits(self) -> int:
        self.state = (self.state + GAMMA) & MASK
        z = self.state
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & MASK
        return z ^ z >> 31

    def under(self, n: int) -> int:
        """0 to n - 1 by the high half of the draw; 0 without a draw when n is 0."""
        return (self.bits() >> 32) * n >> 32 if n else 0

    def in_range(self, low: int, high: int) -> int:
        return low + self.under(high - low + 1)


class Waiting:
    """Orders that wait for their next event; when full, the oldest place is written over in turn."""

    def __init__(self) -> None:
        self.orders: list[tuple[int, int]] = []
        self.turn = 0

    def add(self, order: tuple[int, int]) -> None:
        if len(self.orders) < WAITING:
            self.orders.append(order)
            return
        self.orders[self.turn] = order
        self.turn = (self.turn + 1) % WAITING

    def draw(self, draws: Draws) -> tuple[int, int]:
        i = draws.under(len(self.orders))
        out, last = self.orders[i], self.orders.pop()
        if i < len(self.orders):
            self.orders[i] = last
        return out


@dataclass(frozen=True)
class StorefrontConfig:
    partitions: int = 4
    seed: int = 0
    count: int | None = None
    events_per_tick: int = 10
    tick_ms: int = 100
    clock: str = "fixed"
    epoch_ms: int = 1_704_067_200_000
    encoding: str = "json"

    def __post_init__(self) -> None:
        if self.partitions < 1 or self.events_per_tick < 1 or self.tick_ms < 0 or self.clock not in ("fixed", "wall") or self.encoding not in ("json", "avro"):
            raise ValueError("partitions and events_per_tick must be positive, clock fixed or wall, encoding json or avro")

    def budget(self, lane: int) -> int | None:
        """Events of a lane; lanes' budgets sum to count."""
        if self.count is None:
            return None
        each, more = divmod(self.count, self.partitions)
        return each + (lane < more)


def lane_events(config: StorefrontConfig, lane: int) -> Iterator[tuple[int, dict]]:
    """(event time, event) without end."""
    draws = Draws(config.seed ^ (lane * GAMMA & MASK))
    unpaid, paid, placed, made = Waiting(), Waiting(), 0, 0
    while True:
        at = config.epoch_ms + made if config.clock == "fixed" else time.time_ns() // 1_000_000
        made += 1
        kind = draws.under(100)
        if kind >= PLACES_BELOW and kind < CAPTURES_BELOW and unpaid.orders:
            order = unpaid.draw(draws)
            paid.add(order)
            yield at, {"type": "payment_captured", "order_id": order[0], "amount_cents": order[1]}
        elif kind >= CAPTURES_BELOW and paid.orders:
            number, amount = paid.draw(draws)
            share = draws.in_range(1, 4)
            yield at, {"type": "refund_issued", "order_id": number, "amount_cents": amount // share, "reason": REASONS[draws.under(len(REASONS))]}
        else:
            number = placed * config.partitions + lane
            placed += 1
            lines = []
            for _ in range(draws.in_range(1, 5)):
                item = draws.under(len(SKUS))
                lines.append({"sku": SKUS[item], "qty": draws.in_range(1, 5), "unit_cents": UNIT_CENTS[item]})
            unpaid.add((number, sum(x["qty"] * x["unit_cents"] for x in lines)))
            customer = draws.under(CUSTOMERS)
            yield at, {"type": "order_placed", "order_id": number, "customer_id": customer, "region": REGIONS[draws.under(len(REGIONS))], "placed_at": at, "lines": lines}


def _encode(config: StorefrontConfig, event: dict) -> bytes:
    if config.encoding == "json":
        return json.dumps(event, separators=(",", ":")).encode()
    from ..functions import avro

    name = {"order_placed": "OrderPlaced", "payment_captured": "PaymentCaptured", "refund_issued": "RefundIssued"}[event["type"]]
    return avro.encode(EVENT_SCHEMA, {**event, "_type": name})


class _Span(InputPartition):
    def __init__(self, lane: int, start: int, end: int) -> None:
        self.lane, self.start, self.end = lane, start, end


class _Base:
    def __init__(self, config: StorefrontConfig) -> None:
        self.config = config

    def read(self, p: _Span) -> Iterator[tuple]:
        for i, (at, e) in enumerate(lane_events(self.config, p.lane)):
            if i >= p.end:
                return
            if i >= p.start:
                yield _encode(self.config, e), str(e["order_id"]).encode(), p.lane, i, at


class _Batch(_Base, DataSourceReader):
    def partitions(self) -> list[_Span]:
        if self.config.count is None:
            raise ValueError("a batch of the storefront needs a count")
        return [_Span(i, 0, self.config.budget(i)) for i in range(self.config.partitions)]


class _Stream(_Base, DataSourceStreamReader):
    """Offsets are events by lane; a trigger advances them by the quota of one tick (all that is left when tick is 0)."""

    def __init__(self, config: StorefrontConfig) -> None:
        super().__init__(config)
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {str(i): 0 for i in range(self.config.partitions)}

    def latestOffset(self) -> dict:
        now = self.at or self.initialOffset()
        quota = self.config.events_per_tick
        out = {}
        for lane, n in now.items():
            b = self.config.budget(int(lane))
            out[lane] = n + quota if b is None else b if self.config.tick_ms == 0 else min(b, n + quota)
        self.at = out
        return out

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        self.at = end if self.at is None else self.at
        return [_Span(int(k), start[k], end[k]) for k in end if end[k] > start[k]]

    def commit(self, end: dict) -> None:
        pass


class StorefrontSource(DataSource):
    """spark.dataSource.register(StorefrontSource); spark.read.format("storefront").options(count=..., seed=...)."""

    @classmethod
    def name(cls) -> str:
        return "storefront"

    def schema(self) -> str:
        return ENVELOPE

    def _config(self) -> StorefrontConfig:
        o = self.options
        kinds = {"partitions": int, "seed": int, "count": int, "events_per_tick": int, "tick_ms": int, "epoch_ms": int, "clock": str, "encoding": str}
        return StorefrontConfig(**{k: f(o[k]) for k, f in kinds.items() if o.get(k) is not None})

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._config())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._config())
