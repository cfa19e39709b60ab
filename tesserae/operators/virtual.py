"""Virtual arrays: other arrays' elements at new coordinates, over a fill value; later mappings win."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..array import ArrayFrame, grid
from ..errors import FormatError, SelectionError
from ..functions.convert import saturating
from ..plans.selection import Everything, Hyperslab, Points, Selection, Slices, Span, axis, coordinates
from ..shape import Shape


@dataclass(frozen=True)
class Mapping:
    """Elements of ``source`` under ``src`` appear under ``dst``, the k-th at the k-th place, row-major.  A source of None is missing."""

    source: ArrayFrame | None
    src: Selection
    dst: Selection
    dtype: tuple[str, str] | None = None  # convert from, to


@dataclass(frozen=True)
class VirtualArray:
    shape: Shape
    mappings: tuple[Mapping, ...]
    fill: object
    missing: str = "error"  # or "fill"

    def elements(self) -> DataFrame:
        """Mapped elements only, one for each coordinate."""
        parts = []
        for n, m in enumerate(self.mappings):
            if m.source is None:
                if self.missing != "fill":
                    raise FormatError(f"the source of mapping {n} is missing")
                continue
            parts.append(self._mapped(m).withColumn("mapping", F.lit(n)))
        if not parts:
            raise FormatError("no mapping has a source")
        axes = [axis(i) for i in range(self.shape.rank)]
        both = reduce(DataFrame.unionByName, parts)
        if len(parts) == 1:
            return both.drop("mapping")
        # the last mapping wins; partial aggregation keeps one candidate a coordinate and task
        return both.groupBy(*axes).agg(F.max_by("value", "mapping").alias("value"))

    def _mapped(self, m: Mapping) -> DataFrame:
        out = offset(m, self.shape)
        if out is None:
            out = paired(m, self.shape)
        if m.dtype:
            out = out.withColumn("value", saturating(F.col("value"), *m.dtype))
        inside = reduce(lambda a, b: a & b, [F.col(axis(i)).between(0, d - 1) for i, d in enumerate(self.shape.dims)], F.lit(True))
        return out.where(inside)  # what falls outside the destination is skipped

    def read(self) -> ArrayFrame:
        axes = [axis(i) for i in range(self.shape.rank)]
        found = self.elements()
        out = grid(found.sparkSession, self.shape).join(found, axes, "left") if axes else found
        return ArrayFrame(out.select(*axes, F.coalesce("value", F.lit(self.fill)).alias("value")), self.shape, fill=self.fill)

    def table(self) -> list[dict]:
        """The mappings as plain rows."""
        return [{"mapping": i, "missing": m.source is None, "src": m.src.encode(), "dst": m.dst.encode()} for i, m in enumerate(self.mappings)]


def _spans(s: Selection, shape: Shape) -> tuple[Span, ...] | None:
    if isinstance(s, Everything):
        s = Slices(*[(0, d) for d in shape.dims])
    if isinstance(s, Slices):
        s = s.hyperslab(shape)
    return s.bounded(shape).spans if isinstance(s, Hyperslab) and s.is_set else None


def offset(m: Mapping, shape: Shape) -> DataFrame | None:
    """Source and destination blocks of one form: the remap is arithmetic on each axis, without a join.  None if it is not."""
    a, b = _spans(m.src, m.source.shape), _spans(m.dst, shape)
    if a is None or b is None or len(a) != len(b):
        return None
    cols = []
    for i, (s, d) in enumerate(zip(a, b)):
        if s.size != d.size or not (s.block == d.block or s.count == d.count == 1 or s.stride == s.block and d.stride == d.block):
            return None
        x = F.col(axis(i)) - s.start
        if s.count > 1 and s.block == d.block and s.stride != d.stride:
            block = F.call_function("div", x, F.lit(s.stride).cast("bigint"))
            x = block * d.stride + x % s.stride
        cols.append((x + d.start).alias(axis(i)))
    hit = reduce(lambda p, q: p & q, [s.predicate(F.col(axis(i)), e) for i, (s, e) in enumerate(zip(a, m.source.shape.dims))], F.lit(True))
    return m.source.elements().where(hit).select(*cols, "value")


def paired(m: Mapping, shape: Shape) -> DataFrame:
    """Any two selections of equal size: both sides are numbered in closed form and joined on the number."""
    src = coordinates(m.source.spark, m.src, m.source.shape)
    dst = coordinates(m.source.spark, m.dst, shape)
    n, k = (_size(s, of, c) for s, of, c in ((m.src, m.source.shape, src), (m.dst, shape, dst)))
    if n != k:
        raise SelectionError(f"{n} source elements for {k} places")
    at = [axis(i) for i in range(m.source.shape.rank)]
    found = src.join(m.source.elements(), at).select("pos", "value")
    return found.join(dst, "pos").select(*[axis(i) for i in range(shape.rank)], "value")


def _size(s: Selection, shape: Shape, coords: DataFrame) -> int:
    try:
        return s.count(shape)
    except NotImplementedError:
        return coords.count()


def irregular(source: ArrayFrame, blocks: Sequence[tuple[Sequence[int], Sequence[int]]], places: Sequence[tuple[Sequence[int], Sequence[int]]]) -> list[Mapping]:
    """Block lists (inclusive corners) as one mapping for each pair of blocks."""
    if len(blocks) != len(places):
        raise SelectionError("as many blocks as places are needed")
    box = lambda b: Hyperslab(*[Span(lo, max(1, hi - lo + 1), 1, hi - lo + 1) for lo, hi in zip(*b)])
    return [Mapping(source, box(b), box(p)) for b, p in zip(blocks, places)]


def points(source: ArrayFrame, pairs: Sequence[tuple[Sequence[int], Sequence[int]]]) -> Mapping:
    """(source point, destination point) pairs."""
    return Mapping(source, Points([s for s, _ in pairs]), Points([d for _, d in pairs]))


def extent(lengths: Sequence[int], view: str) -> int:
    """The extent of an unlimited axis over what each mapping can fill: to the last available element, or before the first missing one."""
    if view not in ("last_available", "first_missing"):
        raise FormatError(f"unknown view {view}")
    return (max if view == "last_available" else min)(lengths, default=0)


def expand_name(pattern: str, names: Sequence[str]) -> list[tuple[int, str]]:
    """(block number, name) of the names that a pattern with ``%b`` matches, by number; ``%%`` is a percent sign."""
    if re.search(r"%[^b%]|%$", pattern.replace("%%", "")):
        raise FormatError("only %b and %% may follow a percent sign")
    parts = re.split(r"(%%|%b)", pattern)
    rx = "".join({"%%": "%", "%b": r"(\d+)"}.get(p, re.escape(p)) for p in parts)
    found = []
    for n in names:
        m = re.fullmatch(rx, n)
        if m and m.groups() and len(set(m.groups())) == 1 and str(int(m[1])) == m[1]:
            found.append((int(m[1]), n))
    return sorted(found)


def block_mappings(blocks: Sequence[tuple[int, ArrayFrame]], src: Selection, first: Hyperslab, view: str = "last_available") -> list[Mapping]:
    """One mapping for each numbered source: block b lands b strides along the unlimited axis of ``first``.

    With ``first_missing`` only the numbers below the first gap count.
    """
    if view == "first_missing":
        blocks = [(b, a) for k, (b, a) in enumerate(sorted(blocks, key=lambda x: x[0])) if b == k]
    out = []
    for b, a in blocks:
        spans = [Span(s.start + b * s.stride, s.stride, 1, s.block) if s.count is None else s for s in first.spans]
        out.append(Mapping(a, src, Hyperslab(*spans)))
    return out


def resolve_source(name: str, *, here: str, exists: Callable[[str], bool], prefix: str | None = None, env_prefix: str | None = None) -> str | None:
    """Where a source file is: ``.`` is the file itself; then an absolute path that exists, the access prefix, the environment's prefixes, the file's own folder."""
    if name == ".":
        return here
    folder = here.rsplit("/", 1)[0] if "/" in here else ""
    tries = [name] if name.startswith("/") else []
    if prefix:
        tries.append(f"{prefix.replace('${ORIGIN}', folder)}/{name.rsplit('/', 1)[-1]}")
    for p in (env_prefix or "").split(":"):
        if p:
            tries.append(f"{p.replace('${ORIGIN}', folder)}/{name}")
    tries.append(f"{folder}/{name}" if folder else name)
    return next((t for t in tries if exists(t)), None)


def with_fill(v: VirtualArray, fill: object) -> VirtualArray:
    return replace(v, fill=fill)
