"""The record envelope: payload, key, partition, offset and event time as plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENVELOPE_DDL = "value BINARY, key BINARY, partition INT, offset BIGINT, event_time_ms BIGINT"


def envelope(df: DataFrame, partition: Column, order: Column, key: Column, time: Column, value: Column) -> DataFrame:
    """Adds the envelope's columns; offsets count from 0 in each partition by `order`."""
    out = df.withColumn("partition", partition.cast("int"))
    out = out.withColumn("offset", (F.row_number().over(Window.partitionBy("partition").orderBy(order)) - 1).cast("long"))
    return out.withColumns({"key": key.cast("string").cast("binary"), "event_time_ms": F.unix_millis(time.cast("timestamp")), "value": value.cast("string").cast("binary")})
