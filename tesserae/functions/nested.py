"""Enumerations, bits, arrays, variable-length sequences and maps as column functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FormatError


def enum_name(c: Column, members: Mapping[str, int]) -> Column:
    """The name of a value, null if it has none."""
    if len(set(members.values())) != len(members):
        raise FormatError("two members with one value")
    return F.element_at(F.create_map(*[x for k, v in members.items() for x in (F.lit(v).cast("bigint"), F.lit(k))]), c.cast("bigint")) if members else F.lit(None).cast("string")


def enum_value(c: Column, members: Mapping[str, int]) -> Column:
    """The value of a name, null if it has none."""
    return F.element_at(F.create_map(*[x for k, v in members.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]), c) if members else F.lit(None).cast("bigint")


def bit_field(c: Column, offset: int, size: int) -> Column:
    """``size`` bits from bit ``offset``, as an unsigned number."""
    return F.shiftrightunsigned(c.cast("bigint"), offset).bitwiseAND(F.lit((1 << size) - 1))


def set_bits(c: Column, offset: int, size: int, on: bool) -> Column:
    mask = ((1 << size) - 1) << offset
    return c.cast("bigint").bitwiseOR(F.lit(mask)) if on else c.cast("bigint").bitwiseAND(F.lit(~mask))


def find_bit(c: Column, size: int, on: bool, from_low: bool = True) -> Column:
    """Place of the first bit that is on (or off) among ``size`` bits, from the low or the high end; -1 if none."""
    places = range(size) if from_low else range(size - 1, -1, -1)
    want = 1 if on else 0
    return reduce(lambda out, i: F.when(F.shiftrightunsigned(c.cast("bigint"), i).bitwiseAND(F.lit(1)) == want, i).otherwise(out), reversed(list(places)), F.lit(-1))


def sign_extended(c: Column, precision: int) -> Column:
    """A signed number from its low ``precision`` bits."""
    return F.shiftright(F.shiftleft(c.cast("bigint"), 64 - precision), 64 - precision)


def flattened(c: Column, rank: int) -> Column:
    """A nested array of this rank as one row-major list."""
    for _ in range(rank - 1):
        c = F.flatten(c)
    return c


def reshaped(c: Column, dims: Sequence[int]) -> Column:
    """A row-major list as nested arrays of the given dimensions; another length fails."""
    out = F.when(F.size(c) == prod(dims), c).otherwise(F.raise_error(F.lit(f"{prod(dims)} elements expected")))
    for n in reversed(dims[1:]):
        out = _rows_of(out, n)
    return out


def _rows_of(c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.size(c) / n).cast("int") - 1), lambda i: F.slice(c, i * n + 1, F.lit(n)))


def dims(c: Column, rank: int) -> list[Column]:
    """The length of each axis, from the first element of each."""
    out = []
    for _ in range(rank):
        out.append(F.size(c).cast("bigint"))
        c = F.get(c, F.lit(0))
    return out


def lengths(c: Column) -> Column:
    """Elements of a variable-length sequence; a missing one has none."""
    return F.coalesce(F.size(c), F.lit(0)).cast("bigint") if c is not None else c


def map_put(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def map_delete(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def map_entries_from(m: Column, first: int = 0) -> Column:
    """Entries in key order from the given place: an iteration that can be resumed."""
    entries = F.array_sort(F.map_entries(m))
    return F.slice(entries, first + 1, F.greatest(F.size(entries) - first, F.lit(0)))


def _mask(size: int) -> Column:
    return F.lit((1 << size) - 1 if size < 64 else -1)


def bit_copy(to: Column, to_offset: int, source: Column, offset: int, size: int) -> Column:
    """``to`` with ``size`` bits from bit ``to_offset`` replaced by those of ``source`` from bit ``offset``."""
    bits = F.shiftleft(bit_field(source, offset, size), to_offset)
    return set_bits(to, to_offset, size, False).bitwiseOR(bits)


def bit_shift(c: Column, by: int, offset: int, size: int) -> Column:
    """The field of ``size`` bits from bit ``offset`` shifted left (or right, if negative); what leaves the field is lost."""
    field = bit_field(c, offset, size)
    moved = F.shiftleft(field, by) if by >= 0 else F.shiftrightunsigned(field, -by)
    return bit_copy(c, offset, moved.bitwiseAND(_mask(size)), 0, size)


def bit_add(c: Column, n: int, offset: int, size: int) -> Column:
    """The field plus n, wrapping around: increment with 1, decrement with -1."""
    return bit_copy(c, offset, (bit_field(c, offset, size) + n).bitwiseAND(_mask(size)), 0, size)


def bit_negate(c: Column, offset: int, size: int) -> Column:
    """The field as its two's complement."""
    return bit_copy(c, offset, (-bit_field(c, offset, size)).bitwiseAND(_mask(size)), 0, size)


def bytes_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as byte strings compare."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)
