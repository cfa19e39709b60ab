"""Containers as rows of bytes: what ``spark.read.format("binaryFile")`` gives, from any store Spark reads.

Tasks build and read whole containers in memory, so a file holds a bounded number of elements.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import UnsupportedError
from .codecs import Filter
from .container import Container, Dataset
from .container_writer import ContainerWriter


def build(rows: DataFrame, key: str, order: str, write: Callable[[ContainerWriter, pd.DataFrame], None], old: bool = False) -> DataFrame:
    """``file, content``: one container for each value of ``key``, written by ``write`` from its rows in ``order``; they must fit a task."""

    def run(k: tuple, p: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with ContainerWriter(out, old=old) as w:
            write(w, p.sort_values(order).reset_index(drop=True))
        return pd.DataFrame({"file": [k[0]], "content": [out.getvalue()]})

    return rows.groupBy(F.col(key).cast("bigint").alias("file")).applyInPandas(run, "file bigint, content binary")


def scan(files: DataFrame, read: Callable[[Container, int], Iterator[tuple]], schema: str, limit: int = 10_000) -> DataFrame:
    """The rows that ``read`` finds in every container (file, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, raw in zip(b.column("file").to_pylist(), b.column("content")):
                found = read(Container(raw.as_py()), k)
                while rows := list(islice(found, limit)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    fields = to_arrow_schema(T._parse_datatype_string(schema))
    names, types = fields.names, fields.types
    return files.select("file", "content").mapInArrow(run, schema)


def to_containers(elements: DataFrame, per_file: int, *, chunk: int, growable: int = 0, filters: Sequence[Filter] = (), old: bool = False, name: str = "/data") -> DataFrame:
    """``file, content``: a 1-D array (d0, value) cut into containers of ``per_file`` elements each.

    ``growable`` axes are unlimited: 1 gives an extensible array, 2 (with a second axis of length 1)
    a version 2 tree; a chunk of at least ``per_file`` gives a single chunk.
    """
    filters = tuple(filters)

    def build(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("d0")
        out = io.BytesIO()
        with ContainerWriter(out, old=old) as w:
            x = p["value"].to_numpy()
            x, c, most = (x[:, None], (chunk, 1), (None, None)) if growable == 2 else (x, (chunk,), (None,) if growable else None)
            w.dataset(name, x, chunk=c, max_dims=most, filters=filters)
            w.attr(name, "first", np.int64(p["d0"].iloc[0]))
        return pd.DataFrame({"file": [key[0]], "content": [out.getvalue()]})

    cut = elements.select("d0", "value").withColumn("file", F.call_function("div", F.col("d0"), F.lit(per_file).cast("bigint")))
    return cut.groupBy("file").applyInPandas(build, "file bigint, content binary")


def from_containers(files: DataFrame, name: str = "/data", kind: str = "double", content: str = "content") -> DataFrame:
    """``d0, value`` of the 1-D dataset ``name`` in every container; an attribute ``first`` moves its elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(content):
                c = Container(raw.as_py())
                d = c.dataset(name)
                if d.shape.rank > 2 or d.shape.rank == 2 and d.shape.dims[1] != 1:
                    raise UnsupportedError("a 1-D dataset is needed")
                first = c.attributes(name).get("first", 0)
                for p in d.pieces():
                    coords, values = d.elements(p)
                    yield pa.RecordBatch.from_arrays([pa.array(coords[:, 0] + first), pa.array(values)], names=["d0", "value"])

    return files.select(content).mapInArrow(run, f"d0 bigint, value {kind}")


TREE = "file bigint, path string, link string, kind string, shape string, type string, layout string, filters string"


def trees(files: DataFrame, key: str = "file", content: str = "content") -> DataFrame:
    """The tree of every container: path, link and object kind, and shape, type, storage and filters of datasets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "path", "link", "kind", "shape", "type", "layout", "filters"]
        for b in batches:
            rows = []
            for k, raw in zip(b.column(key).to_pylist(), b.column(content)):
                c = Container(raw.as_py())
                for path, link, kind, target in c.walk():
                    if kind == "dataset":
                        d = Dataset(c, target)
                        rows.append((k, path, link, kind, str(list(d.shape.dims or ())), d.type.spark(), d.layout.get("index", d.layout["kind"]), ",".join(n for n, _ in d.filters)))
                    else:
                        rows.append((k, path, link, kind or None, None, None, None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(zip(*rows))], names=names)

    return files.select(key, content).mapInArrow(run, TREE)
