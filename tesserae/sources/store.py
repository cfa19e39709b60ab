"""A store: a folder of Parquet tables that holds groups, links, attributes and arrays.

Arrays are kept in chunk-partitioned coordinate form, ``chunk`` being the leading chunk number, so
one chunk row is rewritten by a dynamic partition overwrite and selections prune folders.  Metadata
are rows of three small tables; a change writes a new version of one and the newest counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..array import ArrayFrame
from ..errors import FormatError, UnsupportedError
from ..functions.convert import plain_as
from ..functions.text import canonical
from ..operators.chunks import index_kind
from ..operators.namespace import ATTRS, LINKS, OBJECTS, Namespace
from ..plans.selection import Selection, _div, axis
from ..shape import Shape


@dataclass(frozen=True)
class DatasetOptions:
    """How an array is stored."""

    chunk: tuple[int, ...] | None = None
    max_dims: tuple[int | None, ...] | None = None
    fill: object = None
    compression: str = "zstd"
    attrs: dict = field(default_factory=dict)


TABLES = {"links": LINKS, "objects": OBJECTS, "attrs": ATTRS}


class Store:
    def __init__(self, spark: SparkSession, root: str, mode: str = "r"):
        """mode r: must exist; w: made anew; x: must not exist; a: opened or made."""
        self.spark, self.root = spark, root.rstrip("/")
        there = self._exists("objects")
        if mode not in ("r", "w", "x", "a"):
            raise FormatError(f"unknown mode {mode}")
        if mode == "r" and not there:
            raise FormatError(f"no store at {root}")
        if mode == "x" and there:
            raise FormatError(f"a store is at {root} already")
        if mode == "w" and there:
            self._delete("")
            there = False
        self.writable = mode != "r"
        if not there:
            self._save("objects", spark.createDataFrame([(0, "group")], OBJECTS))
            self._save("links", spark.createDataFrame([], LINKS))
            self._save("attrs", spark.createDataFrame([], ATTRS))

    # files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def _delete(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    def _versions(self, table: str) -> list[int]:
        if not self._exists(table):
            return []
        done = [s.getPath() for s in self._fs().listStatus(self._path(table))]
        return sorted(int(p.getName()[1:]) for p in done if p.getName().startswith("v") and self._exists(f"{table}/{p.getName()}/_SUCCESS"))

    def _save(self, table: str, df: DataFrame) -> None:
        if not self.writable:
            raise UnsupportedError("the store is open for reading")
        v = self._versions(table)
        n = v[-1] + 1 if v else 0
        fresh, final = f"{table}/.new-{uuid.uuid4().hex}", f"{table}/v{n:09d}"
        df.coalesce(1).write.parquet(f"{self.root}/{fresh}")
        # whole versions appear at once; another writer's version of the same number is not replaced
        if self._exists(final) or not self._fs().rename(self._path(fresh), self._path(final)):
            self._delete(fresh)
            raise FormatError(f"{table} was changed by another writer")
        for old in v[:-1]:  # readers of the version before finish undisturbed
            self._delete(f"{table}/v{old:09d}")

    def table(self, table: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{table}/v{self._versions(table)[-1]:09d}")

    @property
    def namespace(self) -> Namespace:
        return Namespace(self.table("links"), self.table("objects"), self.table("attrs"), open_file=lambda f: Store(self.spark, self._beside(f)).namespace, name=self.root)

    def _beside(self, name: str) -> str:
        return name if name.startswith("/") or ":" in name.split("/")[0] else f"{self.root.rsplit('/', 1)[0]}/{name}"

    # groups and links

    def link_many(self, links: Sequence[tuple[str, str]]) -> None:
        """Hard links (path, target path) in one new version; the paths must not exist."""
        space, old = self.namespace, self.table("links")
        last = old.agg(F.max("creation_order")).first()[0] or 0
        parents: dict[str, int] = {}
        rows = []
        for k, (path, target) in enumerate(links):
            head, name = canonical(path).rsplit("/", 1)
            if head not in parents:
                parents[head] = space.resolve(head or "/")[1]
            if target not in parents:
                parents[target] = space.resolve(target)[1]
            rows.append((parents[head], name, "hard", str(parents[target]), None, last + 1 + k))
        new = self.spark.createDataFrame(rows, LINKS)
        if len({r[:2] for r in rows}) < len(rows) or old.join(new, ["parent", "name"], "left_semi").limit(1).count():
            raise FormatError("a path exists")
        self._save("links", old.unionAll(new))

    def _parent(self, path: str) -> tuple[int, str]:
        path = canonical(path)
        if path == "/":
            raise FormatError("the root is there already")
        head, name = path.rsplit("/", 1)
        _, parent = self.namespace.resolve(head or "/")
        return parent, name

    def _next(self) -> int:
        return self.table("objects").agg(F.max("object")).first()[0] + 1

    def _link(self, path: str, kind: str, target: str, file: str | None = None) -> None:
        parent, name = self._parent(path)
        links = self.table("links")
        if links.where((F.col("parent") == parent) & (F.col("name") == name)).limit(1).count():
            raise FormatError(f"{path} exists")
        order = (links.agg(F.max("creation_order")).first()[0] or 0) + 1
        self._save("links", links.unionAll(self.spark.createDataFrame([(parent, name, kind, target, file, order)], LINKS)))

    def _object(self, path: str, kind: str) -> int:
        n = self._next()
        self._link(path, "hard", str(n))
        self._save("objects", self.table("objects").unionAll(self.spark.createDataFrame([(n, kind)], OBJECTS)))
        return n

    def create_group(self, path: str) -> int:
        return self._object(path, "group")

    def link_soft(self, path: str, target: str) -> None:
        self._link(path, "soft", target)

    def link_hard(self, path: str, target: str) -> None:
        self._link(path, "hard", str(self.namespace.resolve(target)[1]))

    def link_external(self, path: str, file: str, target: str) -> None:
        self._link(path, "external", target, file)

    def unlink(self, path: str) -> None:
        """Removes a link; an object that no hard link reaches any more goes with its data and attributes."""
        parent, name = self._parent(path)
        links = self.table("links")
        hit = (F.col("parent") == parent) & (F.col("name") == name)
        if not links.where(hit).limit(1).count():
            raise FormatError(f"no link {path}")
        self._save("links", links.where(~hit))
        live = self.table("links").where("kind = 'hard'").select(F.col("target").cast("bigint").alias("object"))
        objects = self.table("objects")
        gone = [r.object for r in objects.where("object > 0").join(live, "object", "left_anti").collect()]
        if gone:
            self._save("objects", objects.where(~F.col("object").isin(gone)))
            self._save("attrs", self.table("attrs").where(~F.col("owner").isin(gone)))
            for n in gone:
                self._delete(f"data/{n}")

    def move(self, path: str, to: str) -> None:
        """Renames a link or moves it to another group; its creation order stays."""
        parent, name = self._parent(path)
        new_parent, new_name = self._parent(to)
        links = self.table("links")
        if links.where((F.col("parent") == new_parent) & (F.col("name") == new_name)).limit(1).count():
            raise FormatError(f"{to} exists")
        hit = (F.col("parent") == parent) & (F.col("name") == name)
        if not links.where(hit).limit(1).count():
            raise FormatError(f"no link {path}")
        self._save("links", links.withColumns({"parent": F.when(hit, F.lit(new_parent)).otherwise(F.col("parent")), "name": F.when(hit, F.lit(new_name)).otherwise(F.col("name"))}))

    # attributes

    def set_attrs(self, path: str, values: dict) -> None:
        """Several new attributes of one object in one new version."""
        _, owner = self.namespace.resolve(path)
        attrs = self.table("attrs")
        if attrs.where((F.col("owner") == owner) & F.col("name").isin(list(values))).limit(1).count():
            raise FormatError("an attribute exists")
        last = attrs.where(F.col("owner") == owner).agg(F.max("creation_order")).first()[0] or 0
        rows = [(owner, name, last + 1 + k, type(v).__name__, json.dumps(v)) for k, (name, v) in enumerate(values.items())]
        self._save("attrs", attrs.unionAll(self.spark.createDataFrame(rows, ATTRS)))

    def set_attr(self, path: str, name: str, value: object, replace: bool = False) -> None:
        _, owner = self.namespace.resolve(path)
        attrs = self.table("attrs")
        hit = (F.col("owner") == owner) & (F.col("name") == name)
        if not replace and attrs.where(hit).limit(1).count():
            raise FormatError(f"attribute {name} exists")
        order = (attrs.where(F.col("owner") == owner).agg(F.max("creation_order")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([(owner, name, order, type(value).__name__, json.dumps(value))], ATTRS)
        self._save("attrs", attrs.where(~hit).unionAll(row))

    def attr(self, path: str, name: str, kind: str | None = None) -> object:
        """One attribute, as ``kind`` (see :func:`tesserae.functions.convert.plain_as`)."""
        _, owner = self.namespace.resolve(path)
        rows = self.table("attrs").where((F.col("owner") == owner) & (F.col("name") == name)).collect()
        if not rows:
            raise FormatError(f"no attribute {name}")
        return plain_as(json.loads(rows[0].value), kind)

    def delete_attr(self, path: str, name: str) -> None:
        self.attr(path, name)
        _, owner = self.namespace.resolve(path)
        self._save("attrs", self.table("attrs").where(~((F.col("owner") == owner) & (F.col("name") == name))))

    def rename_attr(self, path: str, name: str, to: str) -> None:
        self.attr(path, name)
        _, owner = self.namespace.resolve(path)
        attrs = self.table("attrs")
        if attrs.where((F.col("owner") == owner) & (F.col("name") == to)).limit(1).count():
            raise FormatError(f"attribute {to} exists")
        self._save("attrs", attrs.withColumn("name", F.when((F.col("owner") == owner) & (F.col("name") == name), to).otherwise(F.col("name"))))

    # arrays

    def _meta(self, n: int) -> dict:
        text = self.spark.read.text(f"{self.root}/data/{n}/meta", wholetext=True).first()
        return json.loads(text.value)

    def _put_meta(self, n: int, meta: dict) -> None:
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/data/{n}/meta")

    @staticmethod
    def _keyed(df: DataFrame, meta: dict) -> DataFrame:
        chunk = meta["chunk"]
        return df.withColumn("chunk", _div(F.col(axis(0)), chunk[0]) if chunk and meta["dims"] else F.lit(0).cast("bigint"))

    def write(self, path: str, array: ArrayFrame, options: DatasetOptions = DatasetOptions(), check: bool = True) -> int:
        """A new dataset.  With ``check``, elements outside the shape or twice at one place are an error."""
        shape = Shape(array.shape.dims, options.max_dims or array.shape.max_dims)
        chunk = options.chunk or array.chunk
        if shape.is_resizable and not chunk:
            raise FormatError("an array that can grow needs chunks")
        if check and not shape.is_null:
            inside = F.lit(True)
            for i, d in enumerate(shape.dims):
                inside = inside & F.col(axis(i)).between(0, d - 1)
            worst = array.df.agg(F.coalesce(F.min(inside), F.lit(True)).alias("inside"), F.count("*").alias("n")).first()
            if not worst.inside or worst.n > shape.size:
                raise FormatError("elements do not fit the shape")
        n = self._object(path, "dataset")
        meta = {"dims": shape.dims, "max_dims": shape.max_dims, "chunk": chunk, "fill": array.fill if options.fill is None else options.fill, "values": array.values, "ddl": array.df.select(*array.axes, *array.values).schema.simpleString(), "index": index_kind(shape, chunk) if chunk and shape.dims else None}
        self._put_meta(n, meta)
        out = self._keyed(array.elements(), meta)
        if chunk:
            out = out.repartition("chunk").sortWithinPartitions("chunk", *array.axes)
        out.write.partitionBy("chunk").option("compression", options.compression).mode("overwrite").parquet(f"{self.root}/data/{n}/elements")
        if options.attrs:
            self.set_attrs(path, options.attrs)
        return n

    def read(self, path: str) -> ArrayFrame:
        space, n = self.namespace.resolve(path)
        if space.name != self.root:
            return Store(self.spark, space.name)._array(n)
        return self._array(n)

    def _array(self, n: int) -> ArrayFrame:
        meta = self._meta(n)
        shape = Shape(tuple(meta["dims"]) if meta["dims"] is not None else None, tuple(meta["max_dims"]) if meta["max_dims"] else None)
        ddl = meta["ddl"].removeprefix("struct<").removesuffix(">")
        df = self.spark.read.schema(f"{ddl.replace(':', ' ')}, chunk bigint").parquet(f"{self.root}/data/{n}/elements")
        return ArrayFrame(df, shape, tuple(meta["values"]), tuple(meta["chunk"]) if meta["chunk"] else None, meta["fill"])

    def select(self, path: str, selection: Selection) -> DataFrame:
        """The selected elements; the chunk folders outside the selection's box are not listed."""
        a = self.read(path)
        box = selection.bounds(a.shape)
        if box and a.chunk:
            a = a.with_df(a.df.where(F.col("chunk").between(box[0][0] // a.chunk[0], box[1][0] // a.chunk[0])))
        return a.read(selection)

    def write_elements(self, path: str, elements: DataFrame) -> None:
        """Rewrites the chunk folders that ``elements`` touches, keeping their other elements."""
        _, n = self.namespace.resolve(path)
        meta, a = self._meta(n), self._array(n)
        fresh = self._keyed(elements.select(*a.axes, *a.values), meta)
        old = a.df.join(fresh.select("chunk").distinct(), "chunk", "left_semi").join(fresh.select(*a.axes), a.axes, "left_anti")
        both = old.select(*a.axes, *a.values, "chunk").unionByName(fresh).repartition("chunk")
        # read before the overwrite: Spark will not replace files that the same plan reads
        both = both.checkpoint() if self.spark.sparkContext.getCheckpointDir() else self._staged(both, n)
        both.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("chunk").parquet(f"{self.root}/data/{n}/elements")
        self._delete(f"data/{n}/staged")

    def _staged(self, df: DataFrame, n: int) -> DataFrame:
        path = f"{self.root}/data/{n}/staged"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def resize(self, path: str, dims: Sequence[int]) -> None:
        """New dimensions.  Elements outside are deleted from storage, so growing again shows the fill value.

        What stays is staged, and each folder replaced, before anything is deleted: a resize that was
        broken off loses none of it and can be run again.
        """
        _, n = self.namespace.resolve(path)
        meta, a = self._meta(n), self._array(n)
        if not a.chunk:
            raise UnsupportedError("only chunked arrays can be resized")
        shape = a.shape.resized(tuple(dims))
        keep = F.lit(True)
        for i, d in enumerate(dims):
            keep = keep & (F.col(axis(i)) < d)
        if any(new < old for new, old in zip(dims, a.shape.dims)):
            touched = a.df.where(~keep).select("chunk").distinct()
            rest = self._staged(a.df.join(touched, "chunk", "left_semi"), n)
            # one overwrite of the folders that keep elements; folders that keep none go afterwards
            rest.where(keep).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("chunk").parquet(f"{self.root}/data/{n}/elements")
            for r in rest.groupBy("chunk").agg(F.max(keep).alias("some")).where("NOT some").toLocalIterator():
                self._delete(f"data/{n}/elements/chunk={r.chunk}")
            self._delete(f"data/{n}/staged")
        self._put_meta(n, meta | {"dims": shape.dims})

    def describe(self, path: str) -> dict:
        _, n = self.namespace.resolve(path)
        return self._meta(n) | {"object": n}


def options_of(array: ArrayFrame) -> dict:
    return asdict(DatasetOptions(array.chunk, array.shape.max_dims, array.fill))
