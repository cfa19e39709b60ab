"""Record types from Python classes, and strict access to record fields."""

from __future__ import annotations

import dataclasses
import enum
import typing

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FormatError, UnsupportedError
from .convert import spark_type

_PLAIN = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), bool: T.BooleanType()}
MAX_MEMBERS = 4096


def struct_of(cls: type) -> T.StructType:
    """The Spark type of a dataclass.

    A field may name a logical number type or another column: ``field(metadata={"type": "u16",
    "rename": "n"})``.  Nested dataclasses, lists, tuples of one type and enums (by value) are allowed.
    """
    if not dataclasses.is_dataclass(cls):
        raise UnsupportedError(f"{cls.__name__} is no dataclass")
    hints = typing.get_type_hints(cls)
    fields = dataclasses.fields(cls)
    if len(fields) > MAX_MEMBERS:
        raise FormatError(f"over {MAX_MEMBERS} members")
    out = []
    for f in fields:
        name, kind = f.metadata.get("rename", f.name), f.metadata.get("type")
        out.append(T.StructField(name, T._parse_datatype_string(spark_type(kind)) if kind else _type(hints[f.name])))
    names = [f.name for f in out]
    if len(set(names)) != len(names):
        raise FormatError("two members with one name")
    return T.StructType(out)


def _type(hint) -> T.DataType:
    if hint in _PLAIN:
        return _PLAIN[hint]
    if dataclasses.is_dataclass(hint):
        return struct_of(hint)
    if isinstance(hint, type) and issubclass(hint, enum.Enum):
        return T.LongType()
    if typing.get_origin(hint) in (list, tuple):
        return T.ArrayType(_type(typing.get_args(hint)[0]))
    raise UnsupportedError(f"no record type for {hint}")


def member_index(schema: T.StructType, name: str) -> int:
    try:
        return schema.fieldNames().index(name)
    except ValueError:
        raise FormatError(f"no member {name!r}") from None


def read_field(df: DataFrame, path: str, kind: str) -> Column:
    """A record field, which must be stored as exactly this Spark type: nothing is converted or reinterpreted."""
    at: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(at, T.StructType):
            raise FormatError(f"{path} goes through a field that is no record")
        at = at.fields[member_index(at, part)].dataType
    if at.simpleString() != kind:
        raise FormatError(f"{path} is {at.simpleString()}, not {kind}")
    return F.col(path)
