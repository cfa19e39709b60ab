"""Chunks: the unit of storage.  Catalogues, allocation status, pruning, chunk form, index choice."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..array import ArrayFrame
from ..errors import FormatError
from ..plans.selection import Selection, _div, axis
from ..shape import Shape


def chunk_columns(array: ArrayFrame) -> list[Column]:
    if not array.chunk or len(array.chunk) != array.shape.rank:
        raise FormatError("no chunk shape of this rank")
    return [_div(F.col(axis(i)), c).alias(f"c{i}") for i, c in enumerate(array.chunk)]


def catalogue(array: ArrayFrame) -> DataFrame:
    """``c0.., n, first, last``: the chunks that hold elements."""
    lin = array.linear()
    return array.df.groupBy(*chunk_columns(array)).agg(F.count("*").alias("n"), F.min(lin).alias("first"), F.max(lin).alias("last"))


def expected_chunks(array: ArrayFrame) -> int:
    return prod(-(-d // c) for d, c in zip(array.shape.dims, array.chunk))


def space_status(array: ArrayFrame) -> DataFrame:
    """``n_chunks, expected, status``: none, some or all chunks are stored."""
    n = array.df.select(*chunk_columns(array)).distinct().agg(F.count("*").alias("n_chunks"))
    total = F.lit(expected_chunks(array)).cast("bigint")
    status = F.when(F.col("n_chunks") == 0, "not allocated").when(F.col("n_chunks") < total, "part allocated").otherwise("allocated")
    return n.select("n_chunks", total.alias("expected"), status.alias("status"))


def to_chunks(array: ArrayFrame) -> DataFrame:
    """``c0.., at, values``: each chunk's elements with their row-major place inside it.  A chunk is bounded by the chunk shape."""
    inner = F.lit(0).cast("bigint")
    for i, c in enumerate(array.chunk):
        inner = inner * c + F.col(axis(i)) % c
    packed = F.sort_array(F.collect_list(F.struct(inner.alias("at"), *array.values)))
    return array.df.groupBy(*chunk_columns(array)).agg(packed.alias("elements"))


def from_chunks(chunks: DataFrame, like: ArrayFrame) -> ArrayFrame:
    """Coordinate form of :func:`to_chunks`."""
    out = chunks.select(*[f"c{i}" for i in range(like.shape.rank)], F.inline("elements"))
    left, cols = F.col("at"), []
    for i in reversed(range(like.shape.rank)):
        c = like.chunk[i]
        cols.insert(0, (F.col(f"c{i}") * c + left % c).alias(axis(i)))
        left = _div(left, c)
    return like.with_df(out.select(*cols, *like.values))


def pruned(chunks: DataFrame, selection: Selection, shape: Shape, chunk: tuple[int, ...]) -> DataFrame:
    """Only chunks that the selection's bounding box touches, as conditions on the chunk columns, which reach a partitioned scan."""
    box = selection.bounds(shape)
    if box is None:
        return chunks.where(F.lit(False))
    for i, (lo, hi, c) in enumerate(zip(*box, chunk)):
        chunks = chunks.where(F.col(f"c{i}").between(lo // c, hi // c))
    return chunks


def index_kind(shape: Shape, chunk: tuple[int, ...], most: int = 1 << 32) -> str:
    """Which chunk index a writer picks for a shape: recorded as metadata."""
    grows = [i for i, (d, m) in enumerate(zip(shape.dims, shape.largest)) if m is None or m > d]
    unlimited = [i for i in grows if shape.largest[i] is None]
    count = prod(-(-d // c) for d, c in zip(shape.dims, chunk))
    if not grows:
        return "single chunk" if count <= 1 else "fixed array"
    if len(grows) == 1 and len(unlimited) == 1 and count <= most:
        return "extensible array"
    return "b-tree v2"


def index_kind_column(dims: list[Column], largest: list[Column], chunk: tuple[int, ...], most: int = 1 << 32) -> Column:
    """:func:`index_kind` for many shapes at once; a null largest dimension is unlimited."""
    grows = sum((F.when(m.isNull() | (m > d), 1).otherwise(0) for d, m in zip(dims, largest)), F.lit(0))
    unlimited = sum((F.when(m.isNull(), 1).otherwise(0) for m in largest), F.lit(0))
    count = F.lit(1).cast("bigint")
    for d, c in zip(dims, chunk):
        count = count * _div(d + (c - 1), c)
    return (
        F.when((grows == 0) & (count <= 1), "single chunk")
        .when(grows == 0, "fixed array")
        .when((grows == 1) & (unlimited == 1) & (count <= most), "extensible array")
        .otherwise("b-tree v2")
    )
