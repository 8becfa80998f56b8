"""Message-broker options: validation, and the readers and writers they configure (the connector's jar is needed to run)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ConfigError

#: Client properties that typed fields or the delivery guarantee own.
SOURCE_OWNED = ("enable.auto.offset.store", "enable.auto.commit", "auto.commit.enable", "auto.commit.interval.ms", "enable.partition.eof", "bootstrap.servers", "metadata.broker.list", "group.id", "statistics.interval.ms", "group.protocol")
SINK_OWNED = ("bootstrap.servers", "metadata.broker.list", "statistics.interval.ms", "delivery.timeout.ms", "message.timeout.ms", "message.max.bytes", "acks", "request.required.acks", "enable.idempotence", "transactional.id", "delivery.report.only.error", "enable.gapless.guarantee")


def _refuse(given: dict, owned: tuple[str, ...]) -> None:
    if taken := sorted(set(given) & set(owned)):
        raise ConfigError(f"{taken} can't be set here")


@dataclass(frozen=True)
class BrokerSource:
    brokers: str
    topic: str
    group_id: str
    properties: dict = field(default_factory=dict)
    max_offsets_per_trigger: int | None = None

    def __post_init__(self) -> None:
        for name in ("brokers", "topic", "group_id"):
            if not getattr(self, name).strip():
                raise ConfigError(f"{name} must not be empty")
        _refuse(self.properties, SOURCE_OWNED)
        if "cooperative" in str(self.properties.get("partition.assignment.strategy", "")):
            raise ConfigError("cooperative assignment is not supported")

    def options(self) -> dict[str, str]:
        out = {"kafka.bootstrap.servers": self.brokers, "subscribe": self.topic, "kafka.group.id": self.group_id, "startingOffsets": "earliest", "failOnDataLoss": "true"}
        if self.max_offsets_per_trigger:
            out["maxOffsetsPerTrigger"] = str(self.max_offsets_per_trigger)
        return out | {f"kafka.{k}": str(v) for k, v in self.properties.items()}

    def load(self, spark: SparkSession, form: str = "kafka") -> DataFrame:
        """The stream with the envelope's columns; a null payload (a tombstone) is an empty one."""
        return to_envelope(spark.readStream.format(form).options(**self.options()).load())


def to_envelope(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce("value", F.lit(bytearray())).alias("value"), "key", F.col("partition").cast("int").alias("partition"), "offset", F.unix_millis("timestamp").alias("event_time_ms"))


def lag(progress: dict) -> dict[str, int]:
    """Records behind by partition, from the start and latest offsets of a source's progress."""
    import json

    out = {}
    for topic, parts in json.loads(progress["latestOffset"]).items():
        done = json.loads(progress["endOffset"]).get(topic, {})
        out |= {f"{topic}-{p}": max(0, int(n) - int(done.get(p, 0))) for p, n in parts.items()}
    return out


@dataclass(frozen=True)
class BrokerSink:
    brokers: str
    topic: str
    max_message_bytes: int = 1_000_000
    properties: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.brokers.strip() or not self.topic.strip() or self.max_message_bytes < 1:
            raise ConfigError("brokers, topic and a positive max_message_bytes are needed")
        _refuse(self.properties, SINK_OWNED)

    def options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.brokers, "topic": self.topic, "kafka.acks": "all", "kafka.enable.idempotence": "true"} | {f"kafka.{k}": str(v) for k, v in self.properties.items()}

    def fits(self, key: Column, value: Column, headers: Column | None = None) -> Column:
        """Whether key, payload and headers together keep the limit."""
        n = F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))
        if headers is not None:
            n = n + F.coalesce(F.aggregate(headers, F.lit(0), lambda a, h: a + F.octet_length(h["key"]) + F.coalesce(F.octet_length(h["value"]), F.lit(0))), F.lit(0))
        return n <= self.max_message_bytes

    def writer(self, form: str = "kafka"):
        def write(df: DataFrame, batch: int) -> None:
            df.write.format(form).options(**self.options()).save()

        return write
