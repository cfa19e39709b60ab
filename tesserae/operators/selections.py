"""Operators on selected coordinates: counts, bounds, linear runs, projections, shifts, boxes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SelectionError, UnsupportedError
from ..plans.selection import Everything, Selection, axis, coordinates
from ..shape import Shape


def count(spark: SparkSession, s: Selection, shape: Shape) -> DataFrame:
    return coordinates(spark, s, shape).agg(F.count("*").alias("n"))


def bounds(coords: DataFrame, rank: int) -> DataFrame:
    """``lo0, hi0, ...``: the bounding box; nulls if nothing is selected."""
    return coords.agg(*[f(axis(i)).cast("bigint").alias(f"{n}{i}") for i in range(rank) for n, f in (("lo", F.min), ("hi", F.max))])


def linear_bounds(coords: DataFrame, shape: Shape) -> DataFrame:
    """``first, last, n, contiguous``: row-major positions; contiguous if they are one run without repetition."""
    lin = reduce(Column.__add__, [F.col(axis(i)) * s for i, s in enumerate(shape.strides)], F.lit(0).cast("bigint"))
    per = coords.select(lin.alias("lin")).groupBy("lin").agg(F.count("*").alias("k"))
    return per.agg(F.min("lin").alias("first"), F.max("lin").alias("last"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"), (F.count("*") == F.sum("k")).alias("once")).select(
        "first", "last", "n", F.coalesce(F.col("once") & (F.col("last") - F.col("first") + 1 == F.col("n")), F.lit(False)).alias("contiguous")
    )


def project(coords: DataFrame, rank: int, kept: Sequence[int]) -> DataFrame:
    """The distinct coordinates on the kept axes, named d0.. in the order given."""
    if any(not 0 <= k < rank for k in kept):
        raise SelectionError("no such axis")
    return coords.select(*[F.col(axis(k)).alias(f"p{i}") for i, k in enumerate(kept)]).distinct().toDF(*[axis(i) for i in range(len(kept))])


def project_intersection(a: DataFrame, b: DataFrame, rank: int, kept: Sequence[int]) -> DataFrame:
    """The kept axes of the coordinates in both: a semi join, then a projection."""
    on = [axis(i) for i in range(rank)]
    return project(a.join(b.select(*on).distinct(), on, "left_semi"), rank, kept)


def intersects_block(coords: DataFrame, lo: Sequence[int], hi: Sequence[int]) -> DataFrame:
    """``hit``: whether any coordinate lies in the inclusive box."""
    inside = reduce(Column.__and__, [F.col(axis(i)).between(a, b) for i, (a, b) in enumerate(zip(lo, hi))])
    return coords.where(inside).limit(1).agg((F.count("*") > 0).alias("hit"))


def shift(coords: DataFrame, selection: Selection, offsets: Sequence[int]) -> DataFrame:
    """Coordinates moved by the offsets.  The whole-array selection cannot move, and nothing moves below 0."""
    if isinstance(selection, Everything) and any(offsets):
        raise UnsupportedError("a selection of everything has no offset")
    for i, o in enumerate(offsets):
        moved = F.col(axis(i)) + o
        coords = coords.withColumn(axis(i), moved if o >= 0 else F.when(moved >= 0, moved).otherwise(F.raise_error(F.lit("coordinate below 0")).cast("bigint")))
    return coords


def clip(coords: DataFrame, lo: Sequence[int], hi: Sequence[int]) -> DataFrame:
    return coords.where(reduce(Column.__and__, [F.col(axis(i)).between(a, b) for i, (a, b) in enumerate(zip(lo, hi))]))


def merge(*coords: DataFrame) -> DataFrame:
    """Set union of coordinate frames."""
    return reduce(DataFrame.unionByName, coords).distinct()


def count_bounded_axes(coords: DataFrame, shape: Shape) -> DataFrame:
    """``n``: distinct coordinates once unlimited axes are left out."""
    kept = [i for i, m in enumerate(shape.largest) if m is not None]
    return project(coords, shape.rank, kept).agg(F.count("*").alias("n")) if kept else coords.limit(1).agg(F.count("*").alias("n"))


def unlimited_axis(selection: Selection, shape: Shape) -> int | None:
    """The first unlimited axis, if the selection touches anything."""
    return next((i for i, m in enumerate(shape.largest) if m is None), None)
