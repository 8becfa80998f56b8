"""Commit watermarks from batch acknowledgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELIVERED, FAILED, PENDING = "delivered", "failed", "pending"


def watermarks(acks: DataFrame, partition: str = "partition", seq: str = "seq", last: str = "last_offset", status: str = "status") -> DataFrame:
    """For each partition: the end of the contiguous delivered prefix (`watermark`, null if none), whether a failed batch
    stands at its head (`stalled`), and how many batches are held back (`held`)."""
    heads = acks.groupBy(partition).agg(F.min(F.when(F.col(status) != DELIVERED, F.struct(F.col(seq), F.col(status)))).alias("head"))
    both = acks.join(heads, partition)
    before = F.col("head").isNull() | (F.col(seq) < F.col("head")[seq])
    return both.groupBy(partition).agg(
        (F.max(F.when(before, F.col(last))) + 1).alias("watermark"),
        F.coalesce(F.max(F.col("head")[status]) == FAILED, F.lit(False)).alias("stalled"),
        F.count(F.when(~before, 1)).alias("held"),
    )
