"""Arrays as DataFrames in coordinate form: one bigint column for each axis and the value columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import FormatError, SelectionError
from .plans import selection as sel
from .plans.selection import Selection, axis
from .shape import Shape


@dataclass(frozen=True)
class ArrayFrame:
    """An array: its elements, shape, chunk shape, fill value and attributes.  Immutable; operators return new ones.

    ``df`` holds d0.., and ``values``; elements without a row are the fill value (null: none).
    """

    df: DataFrame
    shape: Shape
    values: tuple[str, ...] = ("value",)
    chunk: tuple[int, ...] | None = None
    fill: object = None
    attrs: dict = field(default_factory=dict)

    @property
    def axes(self) -> list[str]:
        return [axis(i) for i in range(self.shape.rank)]

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def with_df(self, df: DataFrame, **changes) -> ArrayFrame:
        return replace(self, df=df, **changes)

    def elements(self) -> DataFrame:
        return self.df.select(*self.axes, *self.values)

    def linear(self) -> Column:
        """Row-major position of an element."""
        out = F.lit(0).cast("bigint")
        for a, s in zip(self.axes, self.shape.strides):
            out = out + F.col(a) * s
        return out

    def read(self, selection: Selection | None = None) -> DataFrame:
        """The selected elements; point lists and overlapping blocks also get ``pos``, their place in the output.

        Predicates carry the bounding box of the selection, so they reach a scan of the coordinate
        columns; coordinate lists are joined, and as they come from the caller they are small.
        """
        selection = selection or sel.Everything()
        selection.validate(self.shape)
        if selection.is_set:
            return self.elements().where(selection.predicate(self.shape))
        at = sel.coordinates(self.spark, selection, self.shape)
        return at.join(self.elements(), self.axes, "left").select("pos", *self.axes, *self.values)

    def __getitem__(self, index) -> DataFrame:
        return self.read(sel.from_index(index, self.shape))

    def cell(self, *at: int) -> DataFrame:
        return self.read(sel.Slices(*[(i, i + 1) for i in at]))

    def vectors(self) -> DataFrame:
        """One row for each index of the leading axes, with the last axis as an array."""
        if self.shape.rank < 1:
            raise SelectionError("a scalar has no axis")
        *lead, last = self.axes
        packed = F.sort_array(F.collect_list(F.struct(last, *self.values)))
        keep = F.transform(packed, lambda x: x[self.values[0]]) if len(self.values) == 1 else packed
        return self.elements().groupBy(*lead).agg(keep.alias("values"))

    def numpy(self):
        """The whole array at the driver.  For small arrays: it is gathered in one place."""
        import numpy as np

        rows = self.elements().toPandas()
        out = np.full(self.shape.dims, self.fill if self.fill is not None else 0, dtype=rows[self.values[0]].dtype)
        if self.shape.rank:
            out[tuple(rows[a].to_numpy() for a in self.axes)] = rows[self.values[0]].to_numpy()
        elif len(rows):
            out[()] = rows[self.values[0]].iloc[0]
        return out


def from_records(df: DataFrame, key: str, n: int, fields: Sequence[str] | None = None) -> ArrayFrame:
    """A table with a dense key as a 1-D array of records."""
    fields = tuple(fields or [c for c in df.columns if c != key])
    return ArrayFrame(df.select(F.col(key).cast("bigint").alias("d0"), *fields), Shape((n,)), fields)


@dataclass(frozen=True)
class VectorRows:
    """A 2-D array stored as rows that hold the last axis as a list.

    Conditions on the second axis cannot reach a scan through an explode, so selections here cut the
    list first and explode only what is left.
    """

    df: DataFrame
    key: str
    vector: str
    shape: Shape

    def array(self) -> ArrayFrame:
        at = F.posexplode(self.vector).alias("d1", "value")
        df = self.df.select(F.col(self.key).cast("bigint").alias("d0"), at)
        return ArrayFrame(df.select("d0", F.col("d1").cast("bigint").alias("d1"), F.col("value").cast("double").alias("value")), self.shape)

    def read(self, selection: Selection) -> DataFrame:
        selection.validate(self.shape)
        if isinstance(selection, sel.Slices):
            selection = selection.hyperslab(self.shape)
        if not isinstance(selection, sel.Hyperslab) or not selection.is_set:
            return self.array().read(selection)
        rows, cols = selection.bounded(self.shape).spans
        wanted = [cols.index(k) for k in range(cols.size)]
        kept = F.transform(F.array(*[F.lit(i) for i in wanted]), lambda i: F.struct(i.cast("bigint").alias("d1"), F.get(self.vector, i).cast("double").alias("value")))
        df = self.df.where(rows.predicate(F.col(self.key), self.shape.dims[0]))
        return df.select(F.col(self.key).cast("bigint").alias("d0"), F.inline(kept)) if wanted else self.array().read(sel.Nothing())


def grid(spark: SparkSession, shape: Shape) -> DataFrame:
    """Every coordinate of a shape, made where it is needed: no data is read."""
    if shape.is_null:
        return spark.createDataFrame([], "d0 bigint")
    return sel.coordinates(spark, sel.Everything(), shape).drop("pos") if shape.rank else spark.range(1).drop("id")


def filled(array: ArrayFrame) -> ArrayFrame:
    """Every element of the shape, missing ones as the fill value."""
    if array.fill is None:
        raise FormatError("no fill value")
    g = grid(array.spark, array.shape)
    out = g.join(array.elements(), array.axes, "left")
    return array.with_df(out.select(*array.axes, *[F.coalesce(F.col(v), F.lit(array.fill)).alias(v) for v in array.values]))
