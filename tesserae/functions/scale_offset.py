"""Scale-offset packing as column arithmetic, chunk by chunk.

Integers are stored as their distance from the chunk's smallest value in just enough bits, with the
all-ones pattern kept for the fill value.  Floats are first scaled by a power of ten and rounded, so
that packing is lossy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bits_for(span: Column, has_fill: bool) -> Column:
    """Bits that hold 0..span, and one pattern more if there is a fill value; 0 for a constant chunk."""
    top = span + 1 if has_fill else span
    need = F.length(F.bin(F.greatest(top, F.lit(0).cast("bigint"))))
    return F.when(span == 0, 0 if not has_fill else 1).otherwise(need).cast("int")


def pack_integers(df: DataFrame, chunk: Sequence[str], value: str = "value", fill: int | None = None) -> DataFrame:
    """Adds ``base, bits, packed`` to each element."""
    v = F.col(value).cast("bigint")
    real = v if fill is None else F.when(v != fill, v)
    w = Window.partitionBy(*chunk)
    df = df.withColumn("base", F.coalesce(F.min(real).over(w), F.lit(0).cast("bigint"))).withColumn("_span", F.coalesce(F.max(real).over(w), F.lit(0).cast("bigint")) - F.col("base"))
    df = df.withColumn("bits", bits_for(F.col("_span"), fill is not None))
    packed = v - F.col("base")
    if fill is not None:
        packed = F.when(v == fill, F.expr("shiftleft(1L, bits) - 1")).otherwise(packed)
    return df.withColumn("packed", packed).drop("_span")


def unpack_integers(df: DataFrame, fill: int | None = None, name: str = "unpacked") -> DataFrame:
    out = F.col("base") + F.col("packed")
    if fill is not None:
        out = F.when(F.col("packed") == F.expr("shiftleft(1L, bits) - 1"), F.lit(fill).cast("bigint")).otherwise(out)
    return df.withColumn(name, out)


def pack_floats(df: DataFrame, chunk: Sequence[str], decimals: int, value: str = "value") -> DataFrame:
    """Adds ``base, bits, packed``: packed = (value - base) * 10^decimals, rounded half away from zero."""
    w = Window.partitionBy(*chunk)
    scale = float(10**decimals)
    df = df.withColumn("base", F.min(value).over(w))
    df = df.withColumn("packed", F.floor((F.col(value) - F.col("base")) * scale + 0.5).cast("bigint"))
    return df.withColumn("bits", bits_for(F.max("packed").over(w), False))


def unpack_floats(df: DataFrame, decimals: int, name: str = "unpacked") -> DataFrame:
    return df.withColumn(name, F.col("packed") / F.lit(float(10**decimals)) + F.col("base"))
