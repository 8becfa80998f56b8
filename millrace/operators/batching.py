"""Sealing rows of a shard into batches with stable tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def seal_rows(df: DataFrame, shard: str, order: list[str], max_rows: int) -> DataFrame:
    """Adds batch_seq: a batch is sealed when it has max_rows rows."""
    if max_rows < 1:
        raise ValueError("max_rows must be positive")
    n = F.row_number().over(Window.partitionBy(shard).orderBy(*order)) - 1
    return df.withColumn("batch_seq", F.floor(n / max_rows).cast("long"))


def seal_bytes(df: DataFrame, shard: str, order: list[str], size: str, max_bytes: int, max_rows: int = 500_000) -> DataFrame:
    """Adds batch_seq: a batch is sealed once its bytes reach max_bytes or its rows max_rows, so it may overshoot by a
    row. Sealing is a fold in order; rows stream through it by shard, sorted, with constant state."""
    shard_at, size_at = df.columns.index(shard), df.columns.index(size)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seq, held, rows = object(), 0, 0, 0
        for pdf in parts:
            out = []
            for s, n in zip(pdf.iloc[:, shard_at].tolist(), pdf.iloc[:, size_at].tolist(), strict=True):
                if s != now:
                    now, seq, held, rows = s, 0, 0, 0
                out.append(seq)
                held, rows = held + int(n), rows + 1
                if held >= max_bytes or rows >= max_rows:
                    seq, held, rows = seq + 1, 0, 0
            yield pdf.assign(batch_seq=out)

    schema = T.StructType([*df.schema.fields, T.StructField("batch_seq", T.LongType())])
    return df.repartition(shard).sortWithinPartitions(shard, *order).mapInPandas(run, schema)


def dedup_token(pipeline: str, run: str, shard: Column, seq: Column) -> Column:
    """`pipeline-run-shard-seq`; with a run id that survives restarts a replayed batch has its first token."""
    return F.concat_ws("-", F.lit(pipeline), F.lit(run), shard.cast("string"), seq.cast("string"))
