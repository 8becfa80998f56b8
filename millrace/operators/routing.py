"""Shard routers: pure Column expressions from the envelope or the payload to a shard number."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a64, golden_mod, limbs_mod, unsigned_mod, xxh64


def key_hash_shard(key: Column, partition: Column, shards: int) -> Column:
    """FNV-1a of the key modulo the shards; rows without a key go by partition. An empty key is a key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    return F.when(key.isNotNull(), limbs_mod(fnv1a64(key), shards)).otherwise(golden_mod(partition, shards)).cast("int")


def weighted_shard(rest: Column, weights: list[int]) -> Column:
    """The shard in whose half-open interval of the weights' sum a remainder falls, in order; weight 0 gets none."""
    if not weights or sum(weights) < 1 or min(weights) < 0:
        raise ValueError("weights must not be negative, and one must be positive")
    out, at = None, 0
    for i, w in enumerate(weights):
        at += w
        if w:
            out = F.when(rest < at, i) if out is None else out.when(rest < at, i)
    return out.cast("int")


def distributed_shard(column: Column, weights: list[int], spark: SparkSession) -> Column:
    """XXH64 (seed 0) of the column modulo the sum of the weights, in consecutive intervals."""
    return weighted_shard(unsigned_mod(xxh64(column, spark), sum(weights)), weights)
