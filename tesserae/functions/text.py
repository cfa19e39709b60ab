"""Strings as stored in arrays: fixed length with padding, variable length, and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL_TERMINATED, NUL_PADDED, SPACE_PADDED = 0, 1, 2


def fixed(c: Column, padding: int = NUL_TERMINATED) -> Column:
    """A fixed-length string: up to the first NUL; trailing white space goes only if it is the padding."""
    out = F.substring_index(c, "\0", 1)
    return F.regexp_replace(out, r"(?U)\s+$", "") if padding == SPACE_PADDED else out


def variable(c: Column) -> Column:
    """A variable-length string: trailing NULs go, a missing one is empty."""
    return F.coalesce(F.regexp_replace(c, "\\x00+$", ""), F.lit(""))


def padded(c: Column, size: int, padding: int = NUL_PADDED) -> Column:
    """Written to a fixed number of bytes; a longer string fails."""
    fill = " " if padding == SPACE_PADDED else "\0"
    room = size - F.octet_length(c)
    return F.when(room >= 0, F.concat(c, F.repeat(F.lit(fill), room))).otherwise(F.raise_error(F.concat(F.lit(f"over {size} bytes: "), c)))


def canonical(path: str) -> str:
    """An absolute path without empty parts, ``.`` and ``..``; the root has no parent."""
    out: list[str] = []
    for p in path.split("/"):
        if p == "..":
            del out[-1:]
        elif p not in ("", "."):
            out.append(p)
    return "/" + "/".join(out)


def canonical_column(c: Column) -> Column:
    """:func:`canonical` for a column."""
    parts = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    stack = F.aggregate(parts, none, lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(stack, "/"))
