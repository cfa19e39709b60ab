"""Containers as a Spark data source: ``spark.read.format("tesserae_container")``.

Options: ``path``; ``dataset``, the path of a dataset; ``fill`` (default true), whether places that
are not stored are rows with the fill value; ``pieces`` (default 64), stored pieces to a task;
``span`` (default 4,194,304), elements to a task where nothing is chunked.  Without ``dataset`` the
rows are the tree: path, link, kind, shape, type and storage.  ``low`` and ``high``, inclusive corners
as comma-separated numbers, prune stored pieces before any is read; :func:`array` sets them from a
selection.  (Conditions are not taken from the plan: Spark keeps one reader for all scans of a loaded
frame, so a union of two differently filtered scans would be pruned by the conditions of one.)
Elements leave as Arrow batches.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pyspark.sql.pandas.types import to_arrow_schema

from ..array import ArrayFrame
from ..errors import FormatError
from ..operators.virtual import Mapping, VirtualArray, block_mappings, expand_name, extent, irregular, resolve_source
from ..plans.selection import Hyperslab, Nothing, Points, Selection, Slices, Span
from ..shape import Shape
from .container import Container, Dataset, Piece, exists, names_in

NAME = "tesserae_container"
TREE = "path string, link string, kind string, shape string, type string, layout string, filters string, stored_bytes bigint"


BATCH = 1 << 16  # elements
MOST_EMPTY = 10_000  # tasks for places that are not stored


class Part(InputPartition):
    """Stored pieces; or elements first..last of a layout without chunks; or the chunk numbers first..last of which only ``stored`` ones are."""

    def __init__(self, pieces: list[Piece] = (), span: tuple[int, int] | None = None, empty: tuple[int, int] | None = None, stored: frozenset[int] = frozenset()):
        self.pieces, self.span, self.empty, self.stored = pieces, span, empty, stored


def field_names(d: Dataset) -> list[str]:
    return [m[0] for m in d.type.members] if d.type.kind == "compound" else ["value"]


def schema_of(d: Dataset) -> str:
    axes = [f"d{i} bigint" for i in range(d.shape.rank)]
    if d.type.kind == "compound":
        return ", ".join(axes + [f"`{n}` {t.spark()}" for n, _, t in d.type.members])
    return ", ".join([*axes, f"value {d.type.spark()}"])


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _open(self) -> Container:
        if "path" not in self.options:
            raise FormatError("the option path is missing")
        return Container(self.options["path"])

    def schema(self) -> str:
        name = self.options.get("dataset")
        return schema_of(self._open().dataset(name)) if name else TREE

    def reader(self, schema) -> DataSourceReader:
        return ElementReader(self.options, to_arrow_schema(schema)) if self.options.get("dataset") else TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def read(self, partition) -> Iterator[tuple]:
        c = Container(self.path)
        for path, link, kind, target in c.walk():
            if kind != "dataset":
                yield path, link, kind or None, None, None, None, None, None
                continue
            d = Dataset(c, target)
            layout = d.layout["kind"]
            stored = sum(p.size for p in d.pieces()) if layout in ("chunked", "contiguous") and not d.external_pieces() else None
            yield path, link, kind, str(list(d.shape.dims or ())), d.type.spark(), d.layout.get("index", layout), ",".join(n for n, _ in d.filters), stored


class ElementReader(DataSourceReader):
    def __init__(self, options: dict, schema: pa.Schema):
        self.path, self.name, self.schema = options["path"], options["dataset"], schema
        self.fill = str(options.get("fill", "true")).lower() == "true"
        self.many = int(options.get("pieces", 64))
        self.span = int(options.get("span", 1 << 22))
        self.low, self.high = ({i: int(v) for i, v in enumerate(options.get(k, "").split(",")) if v.strip()} for k in ("low", "high"))

    def _wanted(self, start: tuple[int, ...], chunk: tuple[int, ...]) -> bool:
        return all(s + c > self.low.get(i, 0) and s <= self.high.get(i, s) for i, (s, c) in enumerate(zip(start, chunk)))

    def partitions(self) -> list[InputPartition]:
        d = Container(self.path).dataset(self.name)
        if not d.shape.size:
            return []
        if d.layout["kind"] != "chunked":
            row = prod(d.shape.dims[1:])
            first = min(d.shape.size, self.low.get(0, 0) * row) if d.shape.rank else 0
            last = min(d.shape.size, (self.high.get(0, d.shape.size) + 1) * row) if d.shape.rank else 1
            return [Part(span=(i, min(last, i + self.span))) for i in range(max(0, first), last, self.span)]
        chunk = d.layout["chunk"]
        stored = d.pieces()
        pieces = [p for p in stored if self._wanted(p.start, chunk)]
        out: list[InputPartition] = [Part(pieces[i : i + self.many]) for i in range(0, len(pieces), self.many)]
        grid = d._grid()
        if self.fill and len(stored) < prod(grid):
            # ranges of chunk numbers: which of them are absent is worked out in the task
            steps = [prod(grid[i + 1 :]) for i in range(len(grid))]
            there = np.sort(np.array([sum(s // c * t for s, c, t in zip(p.start, chunk, steps)) for p in stored], np.int64))
            low = max(0, self.low.get(0, 0)) // chunk[0] * steps[0]
            high = min(prod(grid), (min(self.high.get(0, d.shape.dims[0]), d.shape.dims[0]) // chunk[0] + 1) * steps[0])
            each = max(self.many, -(-(high - low) // MOST_EMPTY))
            for i in range(low, high, each):
                j = min(high, i + each)
                held = there[np.searchsorted(there, i) : np.searchsorted(there, j)]
                if len(held) < j - i:
                    out.append(Part(empty=(i, j), stored=frozenset(held.tolist())))
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        d = Container(self.path).dataset(self.name)
        schema = self.schema
        names = field_names(d) if d.type.kind == "compound" else None

        def batch(coords: np.ndarray, values) -> pa.RecordBatch:
            fields = [np.ascontiguousarray(coords[:, i]) for i in range(coords.shape[1])]
            fields += [[v[n] for v in values] for n in names] if names else [values]
            return pa.RecordBatch.from_arrays([pa.array(f).cast(t) if isinstance(f, np.ndarray) else pa.array(f, t) for f, t in zip(fields, schema.types)], schema=schema)

        if partition.span:
            first, last = partition.span
            for at in range(first, last, BATCH):
                yield batch(*d.linear(at, min(last, at + BATCH)))
        waiting, count = [], 0
        for k, p in enumerate(partition.pieces, 1):
            waiting.append(d.elements(p))
            count += len(waiting[-1][0])
            if count >= BATCH or k == len(partition.pieces):
                values = [v for _, v in waiting]
                yield batch(np.concatenate([c for c, _ in waiting]), np.concatenate(values) if isinstance(values[0], np.ndarray) else [x for v in values for x in v])
                waiting, count = [], 0
        if partition.empty:
            chunk, grid, shape = d.layout["chunk"], d._grid(), d.shape.dims
            for k in range(*partition.empty):
                start = tuple(i * c for i, c in zip(np.unravel_index(k, grid), chunk))
                if k in partition.stored or not self._wanted(start, chunk):
                    continue
                keep = [min(c, n - s) for s, c, n in zip(start, chunk, shape)]
                coords = np.indices(keep, np.int64).reshape(len(keep), prod(keep)).T + np.array(start, np.int64)
                for at in range(0, len(coords), BATCH):
                    part = coords[at : at + BATCH]
                    yield batch(part, [d.fill_value()] * len(part))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    spark.dataSource.register(ContainerSource)


def array(spark: SparkSession, path: str, name: str, within: Selection | list | None = None) -> ArrayFrame:
    """A stored dataset as an array.  ``within``: only pieces that the bounding box of a selection, or of a list of blocks, meets are read."""
    d = Container(path).dataset(name)
    load = spark.read.format(NAME).options(path=path, dataset=name, fill="false")
    box = None
    if isinstance(within, list) and within:
        box = tuple(map(min, zip(*(lo for lo, _ in within)))), tuple(map(max, zip(*(hi for _, hi in within))))
    elif isinstance(within, (Hyperslab, Slices, Points)):
        box = within.bounds(d.shape)
    if box:
        load = load.options(low=",".join(map(str, box[0])), high=",".join(map(str, box[1])))
    chunk = d.layout.get("chunk")
    return ArrayFrame(load.load(), d.shape, tuple(field_names(d)), tuple(chunk) if chunk else None, d.fill_value())


def read(spark: SparkSession, path: str, name: str, selection: Selection):
    """The selected elements of a stored dataset; stored pieces outside the selection's box are not read."""
    return array(spark, path, name, selection).read(selection)


def virtual_array(spark: SparkSession, path: str, name: str, view: str = "last_available", missing: str = "error", prefix: str | None = None) -> VirtualArray:
    """A virtual dataset over the files it names.

    Names with ``%b`` stand for numbered blocks along the unlimited axis; the extent of that axis
    follows from the sources, to the last available block or before the first missing one.
    """
    d = Container(path).dataset(name)
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    find = lambda n: resolve_source(n, here=path, exists=exists, prefix=prefix, env_prefix=os.environ.get("TESSERAE_VDS_PREFIX"))
    found: list[Mapping] = []
    ends: list[int] = []
    grow = next((i for i, m in enumerate(d.shape.largest) if m is None), None)
    for file, inner, src, dst in d.mappings():
        if "%" in file:
            base = f"{folder}/{file}".rsplit("/", 1)[0]
            names = names_in(base)
            blocks = [(b, array(spark, f"{base}/{n}", inner)) for b, n in expand_name(file.rsplit("/", 1)[-1], names)]
            new = block_mappings(blocks, src, dst, view)
        else:
            at = find(file)
            source = array(spark, at, inner, src) if at else None
            if isinstance(src, list) or isinstance(dst, list):
                blocks = src if isinstance(src, list) else [b for b in src.blocks(source.shape)]
                places = dst if isinstance(dst, list) else [b for b in dst.blocks(d.shape)]
                new = irregular(source, blocks, places) if source else [Mapping(None, Nothing(), Nothing())]
            else:
                if source is not None and isinstance(dst, Hyperslab) and any(s.count is None for s in dst.spans):
                    src, dst = _bounded(src, dst, source.shape)
                new = [Mapping(source, src, dst)]
        if grow is not None:
            # numbered blocks count as one mapping that reaches to its last block
            own = [m.dst.spans[grow].last + 1 for m in new if m.source is not None and isinstance(m.dst, Hyperslab) and m.dst.spans[grow].count]
            ends.append(max(own, default=0))
        found += new
    dims = d.shape.dims
    if ends:
        dims = tuple(extent(ends, view) if i == grow else n for i, n in enumerate(dims))
    return VirtualArray(Shape(dims), tuple(found), d.fill_value(), missing)


def _bounded(src, dst: Hyperslab, shape: Shape) -> tuple[Hyperslab, Hyperslab]:
    """Both sides of an unlimited mapping cut to what the source has."""
    if not isinstance(src, Hyperslab):
        src = Hyperslab(*[Span(0, 1, None, 1) if t.count is None else Span(0, max(1, n), 1, n) for n, t in zip(shape.dims, dst.spans)])
    have = src.bounded(shape)
    out = []
    for s, t in zip(have.spans, dst.spans):
        out.append(Span(t.start, t.stride, max(0, s.size // max(1, t.block)), t.block) if t.count is None else t)
    return have, Hyperslab(*out)
