"""Unsigned 64-bit hashes as Column expressions that never overflow a BIGINT."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The FNV-1a 64 offset basis in two 32-bit limbs, the low part of its prime, and the golden ratio.
FNV_HI, FNV_LO, FNV_PRIME_LO = 0xCBF29CE4, 0x84222325, 0x1B3
GOLDEN = 0x9E3779B97F4A7C15
MASK = 0xFFFFFFFF


def _byte(data: Column, i: Column) -> Column:
    return F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")


def fnv1a64(data: Column) -> Column:
    """FNV-1a 64 of a binary column as struct<hi, lo> of unsigned 32-bit limbs; null for null."""
    start = F.struct(F.lit(FNV_HI).cast("long").alias("hi"), F.lit(FNV_LO).cast("long").alias("lo"))

    def step(acc: Column, i: Column) -> Column:
        # The prime is 2**40 + 0x1b3: the limbs' products stay below 2**42.
        x = acc["lo"].bitwiseXOR(_byte(data, i))
        low = x * FNV_PRIME_LO
        high = acc["hi"] * FNV_PRIME_LO + F.shiftright(low, 32) + x * 256
        return F.struct(high.bitwiseAND(F.lit(MASK)).alias("hi"), low.bitwiseAND(F.lit(MASK)).alias("lo"))

    n = F.octet_length(data)
    return F.when(data.isNotNull(), F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), start, step))


def limbs_mod(limbs: Column, n: int) -> Column:
    """The unsigned value modulo n (n below 2**31)."""
    return F.pmod(F.pmod(limbs["hi"], F.lit(n)) * ((1 << 32) % n) + F.pmod(limbs["lo"], F.lit(n)), F.lit(n))


def signed(limbs: Column) -> Column:
    """The 64-bit pattern as a BIGINT."""
    hi = F.when(limbs["hi"] >= 1 << 31, limbs["hi"] - (1 << 32)).otherwise(limbs["hi"])
    return F.shiftleft(hi, 32).bitwiseOR(limbs["lo"])


def golden_mod(partition: Column, n: int) -> Column:
    """(partition times the golden ratio modulo 2**64) modulo n, for unsigned 32-bit partitions."""
    p = partition.cast("long")
    # 16-bit pieces of the constant keep each product below 2**48.
    parts = [(GOLDEN >> (16 * k)) & 0xFFFF for k in range(4)]
    carry: Column = F.lit(0).cast("long")
    words = []
    for c in parts:
        t = p * c + carry
        words.append(t.bitwiseAND(F.lit(0xFFFF)))
        carry = F.shiftright(t, 16)
    out = F.lit(0).cast("long")
    for w in reversed(words):
        out = F.pmod(out * (65536 % n) + w, F.lit(n))
    return out


def xxh64(column: Column, spark: SparkSession) -> Column:
    """Canonical XXH64 with seed 0 of a long (8 bytes LE), int (4 bytes LE), string or binary column, as a signed BIGINT.
    The SQL function of the engine fixes another seed, so the expression is built with the seed given."""
    jvm = spark._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    children = _one(jvm, utils.expression(column._jc))
    expression = jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(children, 0)
    from pyspark.sql.classic.column import Column as ClassicColumn

    return ClassicColumn(utils.column(expression))


def _one(jvm, x):
    items = jvm.java.util.ArrayList()
    items.add(x)
    return jvm.scala.jdk.javaapi.CollectionConverters.asScala(items).toSeq()


def unsigned_mod(h: Column, n: int) -> Column:
    """A signed 64-bit pattern, read as unsigned, modulo n."""
    return F.pmod(F.pmod(h, F.lit(n)) + F.when(h < 0, F.lit((1 << 64) % n)).otherwise(F.lit(0)), F.lit(n))
