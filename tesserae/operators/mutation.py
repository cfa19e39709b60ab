"""Changing arrays: resize, chunk writes, filling a selection.  Every change is a new array."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..array import ArrayFrame, filled
from ..errors import FormatError, UnsupportedError
from ..plans.selection import Selection, axis
from .chunks import chunk_columns


def resize(array: ArrayFrame, dims: tuple[int, ...]) -> ArrayFrame:
    """Chunked arrays only.  Elements outside the new shape are gone for good; new ones read as the fill value."""
    if array.chunk is None:
        raise UnsupportedError("only chunked arrays can be resized")
    shape = array.shape.resized(tuple(dims))
    keep = F.lit(True)
    for i, (new, old) in enumerate(zip(dims, array.shape.dims)):
        if new < old:
            keep = keep & (F.col(axis(i)) < new)
    return replace(array, df=array.df.where(keep), shape=shape)


def grown(array: ArrayFrame, dims: tuple[int, ...]) -> ArrayFrame:
    """Resized, with every element present."""
    return filled(resize(array, dims))


def write_chunk(array: ArrayFrame, at: tuple[int, ...], elements: DataFrame) -> ArrayFrame:
    """Replaces the chunk whose first element is ``at``; ``elements`` has the coordinates and values of the whole chunk."""
    if array.chunk is None or any(x % c for x, c in zip(at, array.chunk)):
        raise FormatError("not the first element of a chunk")
    inside = F.lit(True)
    for i, (x, c, d) in enumerate(zip(at, array.chunk, array.shape.dims)):
        inside = inside & F.col(axis(i)).between(x, min(x + c, d) - 1)
    fresh = elements.select(*array.axes, *array.values)
    return array.with_df(array.elements().where(~inside).unionByName(fresh.where(inside)))


def write_chunks(array: ArrayFrame, elements: DataFrame) -> ArrayFrame:
    """Replaces every chunk that ``elements`` touches: what a dynamic partition overwrite does in storage."""
    new = array.with_df(elements.select(*array.axes, *array.values))
    ids = [f"c{i}" for i in range(array.shape.rank)]
    touched = new.df.select(*chunk_columns(new)).distinct()
    old = array.elements().select("*", *chunk_columns(array)).join(touched, ids, "left_anti").drop(*ids)
    return array.with_df(old.unionByName(new.df))


def fill_selection(array: ArrayFrame, selection: Selection, value: object, column: str | None = None) -> ArrayFrame:
    """Sets the selected elements to one value."""
    selection.validate(array.shape)
    column = column or array.values[0]
    hit: Column = selection.predicate(array.shape)
    return array.with_df(array.elements().withColumn(column, F.when(hit, F.lit(value)).otherwise(F.col(column))))
