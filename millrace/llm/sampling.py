"""Bounded samples by class."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACE = 1 << 40


def lowest(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """Of each class (a column without nulls, few values) n keys: those that hash lowest, or all if there are fewer. Rows of
    equal class and key are one row, with the least value in each other column.

    The keys of classes are counted first (by a sketch), and only rows below a threshold that n rows of the class are all but sure to meet
    are ranked, so that the ranking's input has a bound of about n rows a class, whatever the table's size."""
    counts = {r[by]: max(1, r["n"]) for r in rows.groupBy(by).agg(F.approx_count_distinct(key, 0.02).alias("n")).collect()}
    if not counts:
        return rows
    share = {k: min(1.0, (1.1 * n + 6 * n**0.5 + 20) / c) for k, c in counts.items()}
    limit = F.create_map(*[F.lit(x) for x in chain.from_iterable(share.items())])[F.col(by)]
    low = rows.where(F.pmod(F.xxhash64(key), F.lit(SPACE)) <= limit * SPACE)
    rest = [F.min(c).alias(c) for c in rows.columns if c not in (by, key)]
    low = low.groupBy(by, key).agg(*rest) if rest else low.select(by, key).distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.pmod(F.xxhash64(key), F.lit(SPACE)), key))
    return low.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
