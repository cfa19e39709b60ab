"""Selections of array elements, compiled to predicates or to coordinate frames.

A selection is a small driver-side value.  Where every element is chosen at most once it becomes a
predicate on coordinate columns, whose bounding box is written first so that it reaches the scan;
where order or repetition counts (points, overlapping blocks) it becomes a frame of coordinates
with a position, to be joined.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SelectionError, UnsupportedError
from ..shape import Shape


def axis(i: int) -> str:
    return f"d{i}"


@dataclass(frozen=True)
class Span:
    """Regular blocks on one axis: ``count`` blocks of ``block`` elements, ``stride`` apart.  A count of None goes on to the extent."""

    start: int
    stride: int = 1
    count: int | None = 1
    block: int = 1

    def __post_init__(self):
        if self.start < 0 or self.stride < 0 or self.block < 0 or (self.count or 0) < 0:
            raise SelectionError("negative span")
        if self.count == 0:
            return
        if self.stride == 0:
            raise SelectionError("stride 0")
        if self.block == 0:
            raise SelectionError("block 0")

    def bounded(self, extent: int) -> Span:
        """With a count for this extent; of an unlimited span, blocks that begin inside."""
        if self.count is not None:
            return self
        return Span(self.start, self.stride, max(0, -(-(extent - self.start) // self.stride)), self.block)

    @property
    def size(self) -> int:
        return self.count * self.block

    @property
    def last(self) -> int:
        return self.start + (self.count - 1) * self.stride + self.block - 1

    @property
    def overlaps(self) -> bool:
        return (self.count is None or self.count > 1) and self.stride < self.block

    def index(self, k: int) -> int:
        return self.start + k // self.block * self.stride + k % self.block

    def predicate(self, d: Column, extent: int) -> Column:
        if self.count == 0:
            return F.lit(False)
        end = extent - 1 if self.count is None else self.last
        box = (d >= self.start) & (d <= end)
        if self.count == 1 or self.stride == self.block:
            return box
        return box & ((d - self.start) % self.stride < self.block)


class Selection:
    """Base of all selections; the operators |, &, ^ and - combine them as sets."""

    kind = ""

    def validate(self, shape: Shape) -> None: ...

    def output_shape(self, shape: Shape) -> tuple[int, ...]:
        raise NotImplementedError

    def count(self, shape: Shape) -> int:
        self.validate(shape)
        return prod(self.output_shape(shape))

    def predicate(self, shape: Shape) -> Column:
        raise NotImplementedError

    @property
    def is_set(self) -> bool:
        """Whether a predicate says all: no order of its own, no repetition."""
        return True

    @property
    def is_regular(self) -> bool:
        return False

    def bounds(self, shape: Shape) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """Inclusive corners, None if empty."""
        raise UnsupportedError(f"bounds of {self.kind} come from its coordinates")

    def __or__(self, other):
        return Combined("or", self, other)

    def __and__(self, other):
        return Combined("and", self, other)

    def __xor__(self, other):
        return Combined("xor", self, other)

    def __sub__(self, other):
        return Combined("and_not", self, other)

    def encode(self) -> str:
        return json.dumps(self._plain())

    def _plain(self) -> dict:
        return {"kind": self.kind}

    @staticmethod
    def decode(text: str) -> Selection:
        return _decode(json.loads(text))


@dataclass(frozen=True)
class Nothing(Selection):
    kind = "none"

    def output_shape(self, shape):
        return (0,)

    def predicate(self, shape):
        return F.lit(False)

    def bounds(self, shape):
        return None


@dataclass(frozen=True)
class Everything(Selection):
    kind = "all"

    def output_shape(self, shape):
        return (0,) if shape.is_null else shape.dims

    def predicate(self, shape):
        return F.lit(True)

    def bounds(self, shape):
        return None if shape.size == 0 else (tuple(0 for _ in shape.dims), tuple(d - 1 for d in shape.dims))


@dataclass(frozen=True)
class Points(Selection):
    """Listed elements; order and repetitions are kept."""

    coords: tuple[tuple[int, ...], ...]
    kind = "points"

    def __init__(self, coords):
        object.__setattr__(self, "coords", tuple(tuple(int(x) for x in c) for c in coords))

    def validate(self, shape):
        for c in self.coords:
            if len(c) != shape.rank:
                raise SelectionError("point of another rank")
            if any(not 0 <= x < d for x, d in zip(c, shape.dims)):
                raise SelectionError(f"point {c} is outside {shape.dims}")

    def output_shape(self, shape):
        return (len(self.coords),)

    @property
    def is_set(self):
        return False

    def predicate(self, shape):
        """Membership; for an array read use coordinates, which keep order and repetitions."""
        each = [reduce(Column.__and__, [F.col(axis(i)) == x for i, x in enumerate(c)], F.lit(True)) for c in dict.fromkeys(self.coords)]
        return reduce(Column.__or__, each, F.lit(False))

    def bounds(self, shape):
        return (tuple(map(min, zip(*self.coords))), tuple(map(max, zip(*self.coords)))) if self.coords else None

    def _plain(self):
        return {"kind": self.kind, "coords": self.coords}


@dataclass(frozen=True)
class Hyperslab(Selection):
    """A regular block pattern on every axis."""

    spans: tuple[Span, ...]
    kind = "hyperslab"

    def __init__(self, *spans):
        object.__setattr__(self, "spans", tuple(s if isinstance(s, Span) else Span(*s) for s in spans))

    def bounded(self, shape: Shape) -> Hyperslab:
        return Hyperslab(*[s.bounded(d) for s, d in zip(self.spans, shape.dims)])

    def validate(self, shape):
        if len(self.spans) != shape.rank:
            raise SelectionError("hyperslab of another rank")
        for s, d in zip(self.spans, shape.dims):
            if s.count and s.last >= d:
                raise SelectionError(f"block ends at {s.last}, the extent is {d}")

    def output_shape(self, shape):
        return tuple(s.size for s in self.bounded(shape).spans)

    @property
    def is_set(self):
        return not any(s.overlaps for s in self.spans)

    @property
    def is_regular(self):
        return True

    def predicate(self, shape):
        return reduce(Column.__and__, [s.predicate(F.col(axis(i)), d) for i, (s, d) in enumerate(zip(self.spans, shape.dims))], F.lit(True))

    def bounds(self, shape):
        spans = self.bounded(shape).spans
        if any(s.count == 0 for s in spans):
            return None
        return tuple(s.start for s in spans), tuple(min(s.last, d - 1) for s, d in zip(spans, shape.dims))

    def blocks(self, shape: Shape) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """Inclusive corners of every block, row-major."""
        spans = self.bounded(shape).spans
        each = [[(s.start + k * s.stride, s.start + k * s.stride + s.block - 1) for k in range(s.count)] for s in spans]
        return [tuple(zip(*b)) for b in product(*each)]

    def slices(self, shape: Shape) -> Slices:
        """The same elements as slices; blocks that a step cannot say are an error."""
        out = []
        for s in self.bounded(shape).spans:
            if s.count == 0:
                out.append((0, 0, 1))
            elif s.count == 1 or s.stride == s.block:
                out.append((s.start, s.last + 1, 1))
            elif s.block == 1:
                out.append((s.start, s.last + 1, s.stride))
            else:
                raise UnsupportedError("blocks are no slices")
        return Slices(*out)

    def _plain(self):
        return {"kind": self.kind, "spans": [(s.start, s.stride, s.count, s.block) for s in self.spans]}


@dataclass(frozen=True)
class Slices(Selection):
    """Half-open ranges with a step on every axis; None takes the extent's end."""

    ranges: tuple[tuple[int, int | None, int], ...]
    kind = "slices"

    def __init__(self, *ranges):
        out = []
        for r in ranges:
            if isinstance(r, slice):
                r = (r.start or 0, r.stop, r.step if r.step is not None else 1)
            out.append((r[0], r[1], r[2] if len(r) > 2 else 1))
        object.__setattr__(self, "ranges", tuple(out))

    def filled(self, shape: Shape) -> list[tuple[int, int, int]]:
        return [(a, d if b is None else b, s) for (a, b, s), d in zip(self.ranges, shape.dims)]

    def validate(self, shape):
        if len(self.ranges) != shape.rank:
            raise SelectionError("slices of another rank")
        for (a, b, s), d in zip(self.filled(shape), shape.dims):
            if s <= 0:
                raise SelectionError("step 0")
            if not (0 <= a <= d and 0 <= b <= d):
                raise SelectionError(f"slice {a}..{b} is outside {d}")

    def output_shape(self, shape):
        return tuple(max(0, -(-(b - a) // s)) for a, b, s in self.filled(shape))

    @property
    def is_regular(self):
        return True

    def predicate(self, shape):
        out = F.lit(True)
        for i, (a, b, s) in enumerate(self.filled(shape)):
            d = F.col(axis(i))
            out = out & (d >= a) & (d < b)
            if s > 1:
                out = out & ((d - a) % s == 0)
        return out

    def bounds(self, shape):
        n = self.output_shape(shape)
        if 0 in n:
            return None
        r = self.filled(shape)
        return tuple(a for a, _, _ in r), tuple(a + (k - 1) * s for (a, _, s), k in zip(r, n))

    def hyperslab(self, shape: Shape) -> Hyperslab:
        """The same elements as blocks; a step of 1 is one block, a longer one has a block for each element."""
        return Hyperslab(*[Span(a, max(1, n), 1 if n else 0, max(1, n)) if s == 1 else Span(a, s, n, 1) for (a, _, s), n in zip(self.filled(shape), self.output_shape(shape))])

    def _plain(self):
        return {"kind": self.kind, "ranges": self.ranges}


@dataclass(frozen=True)
class Combined(Selection):
    """Two selections as sets: or, and, xor, and_not.  No materialisation, so no limit on their size."""

    op: str
    left: Selection
    right: Selection
    kind = "combined"

    def validate(self, shape):
        self.left.validate(shape)
        self.right.validate(shape)

    def predicate(self, shape):
        a, b = self.left.predicate(shape), self.right.predicate(shape)
        return {"or": a | b, "and": a & b, "xor": a != b, "and_not": a & ~b}[self.op]

    def output_shape(self, shape):
        raise UnsupportedError("the size of a combined selection is a count over its coordinates")

    def count(self, shape):
        raise UnsupportedError("the size of a combined selection is a count over its coordinates")

    def _plain(self):
        return {"kind": self.kind, "op": self.op, "left": self.left._plain(), "right": self.right._plain()}


def _decode(x: dict) -> Selection:
    match x["kind"]:
        case "none":
            return Nothing()
        case "all":
            return Everything()
        case "points":
            return Points(x["coords"])
        case "hyperslab":
            return Hyperslab(*[tuple(s) for s in x["spans"]])
        case "slices":
            return Slices(*[tuple(r) for r in x["ranges"]])
        case "combined":
            return Combined(x["op"], _decode(x["left"]), _decode(x["right"]))
    raise SelectionError(f"unknown selection {x['kind']}")


def from_index(index, shape: Shape) -> Selection:
    """``array[index]`` notation: slices, open ends, ints, ``...`` or a tuple of them."""
    items = index if isinstance(index, tuple) else (index,)
    if Ellipsis in items:
        at = items.index(Ellipsis)
        items = items[:at] + (slice(None),) * (shape.rank - len(items) + 1) + items[at + 1 :]
    if all(i == slice(None) for i in items) and len(items) <= shape.rank:
        return Everything()
    items += (slice(None),) * (shape.rank - len(items))
    return Slices(*[slice(i, i + 1) if isinstance(i, int) else i for i in items])


def coordinates(spark: SparkSession, selection: Selection, shape: Shape) -> DataFrame:
    """``pos, d0, d1, ...``: the selected coordinates with their place in the output, repetitions included."""
    selection.validate(shape)
    cols = [axis(i) for i in range(shape.rank)]
    if isinstance(selection, Points):
        rows = [(k, *c) for k, c in enumerate(selection.coords)]
        return spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in ["pos", *cols]))
    if isinstance(selection, Nothing) or shape.is_null:
        return spark.createDataFrame([], ", ".join(f"{c} bigint" for c in ["pos", *cols]))
    if isinstance(selection, Combined):
        # only elements of both sides' bounding boxes are looked at
        lo, hi = _box(selection, shape)
        inner = Slices(*[(a, b + 1) for a, b in zip(lo, hi)]) if lo else Nothing()
        return coordinates(spark, inner, shape).where(selection.predicate(shape))
    if isinstance(selection, Everything):
        selection = Slices(*[(0, d) for d in shape.dims])
    if isinstance(selection, Slices):
        spans = selection.hyperslab(shape).spans
    else:
        spans = selection.bounded(shape).spans
    sizes = [s.size for s in spans]
    out = spark.range(prod(sizes)).withColumnRenamed("id", "pos")
    left = F.col("pos")
    made = {}
    for i in reversed(range(len(spans))):
        k = left % sizes[i]
        s = spans[i]
        made[axis(i)] = F.lit(s.start) + _div(k, s.block) * s.stride + k % s.block
        left = _div(left, sizes[i])
    return out.select("pos", *[made[c].cast("bigint").alias(c) for c in cols])


def _box(s: Selection, shape: Shape) -> tuple[tuple[int, ...], tuple[int, ...]]:
    if not isinstance(s, Combined):
        return s.bounds(shape) or ((), ())
    (a, b), (c, d) = _box(s.left, shape), _box(s.right, shape)
    if s.op == "and_not" or not c:
        return (a, b) if s.op != "and" or c else ((), ())
    if not a:
        return (c, d) if s.op != "and" else ((), ())
    if s.op == "and":
        lo, hi = tuple(map(max, a, c)), tuple(map(min, b, d))
        return (lo, hi) if all(x <= y for x, y in zip(lo, hi)) else ((), ())
    return tuple(map(min, a, c)), tuple(map(max, b, d))


def _div(a: Column, n: int) -> Column:
    """Whole-number quotient of a non-negative bigint."""
    return a if n == 1 else F.call_function("div", a, F.lit(n).cast("bigint"))
