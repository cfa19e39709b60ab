"""Saturating conversion between element types.

Integers are clamped to the target's range, floats truncate toward zero and NaN becomes 0: no
conversion fails or yields null.  ANSI casts would raise instead, so every range is tested first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedError

#: Logical type: Spark type, and the range of integers.
INTEGERS = {
    "i8": ("tinyint", -(2**7), 2**7 - 1),
    "i16": ("smallint", -(2**15), 2**15 - 1),
    "i32": ("int", -(2**31), 2**31 - 1),
    "i64": ("bigint", -(2**63), 2**63 - 1),
    "u8": ("smallint", 0, 2**8 - 1),
    "u16": ("int", 0, 2**16 - 1),
    "u32": ("bigint", 0, 2**32 - 1),
    "u64": ("decimal(20,0)", 0, 2**64 - 1),
}
FLOATS = {"f32": "float", "f64": "double"}
#: Classes that behave like their integer base.
LIKE = {"enum": "base", "bitfield": "unsigned", "time": "base"}


def spark_type(t: str) -> str:
    if t in INTEGERS:
        return INTEGERS[t][0]
    if t in FLOATS:
        return FLOATS[t]
    raise UnsupportedError(f"no numeric type {t}")


def saturating(c: Column, source: str, target: str) -> Column:
    """``c`` of logical type ``source`` as ``target``."""
    if source == target:
        return c.cast(spark_type(target))
    if target in FLOATS:
        return c.cast("double").cast(FLOATS[target])
    if target not in INTEGERS:
        raise UnsupportedError(f"cannot convert {source} to {target}")
    kind, lo, hi = INTEGERS[target]
    number = lambda v: F.lit(str(v)).cast(kind) if abs(v) >= 2**63 else F.lit(v).cast(kind)
    if source in FLOATS:
        x = c.cast("double")
        low, high = number(lo), number(hi)
        # NaN first: Spark orders it above every number
        inside = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)) if target != "u64" else F.floor(x.cast("decimal(38,6)"))
        return F.when(F.isnan(x), F.lit(0).cast(kind)).when(x <= float(lo), low).when(x >= float(hi), high).otherwise(inside.cast(kind))
    if source not in INTEGERS:
        raise UnsupportedError(f"cannot convert {source} to {target}")
    _, slo, shi = INTEGERS[source]
    wide = "decimal(20,0)" if "u64" in (source, target) else "bigint"
    x = c.cast(wide)
    if slo < lo:
        x = F.greatest(x, F.lit(str(lo)).cast(wide))
    if shi > hi:
        x = F.least(x, F.lit(str(hi)).cast(wide))
    return x.cast(kind)


def saturating_array(c: Column, source: str, target: str) -> Column:
    """Element by element; nulls stay."""
    return F.transform(c, lambda x: saturating(x, source, target))


def same_length(c: Column, n: int) -> Column:
    """``c`` if it has n elements; anything else raises."""
    return F.when(F.size(c) == n, c).otherwise(F.raise_error(F.lit(f"array dimensions differ: {n} expected")))


def plain_as(value: object, kind: str | None) -> object:
    """A metadata value, scalar or list, as ``kind``: an integer or float type of above, ``bool`` or ``string``; None leaves it.

    Numbers saturate as columns do; a number is true unless it is 0; strings are no numbers.
    """
    if kind is None:
        return value
    if isinstance(value, (list, tuple)):
        return [plain_as(v, kind) for v in value]
    if kind == "string":
        if isinstance(value, str):
            return value
        raise UnsupportedError(f"{value!r} is no string")
    if isinstance(value, str) or value is None:
        raise UnsupportedError(f"{value!r} is no number")
    if kind == "bool":
        return bool(value)
    if kind in FLOATS:
        return float(value)
    if kind not in INTEGERS:
        raise UnsupportedError(f"no numeric type {kind}")
    _, low, high = INTEGERS[kind]
    if value != value:
        return 0
    return int(max(low, min(high, value)))
