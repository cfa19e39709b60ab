"""Groups, links and attributes as tables.

``links`` holds parent, name, kind (hard, soft, external), target (a path, or an object id for hard
links), target_file and creation_order; ``objects`` holds object, kind (group, dataset, datatype);
``attrs`` holds owner (object), name, creation_order, dtype and value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FormatError, UnsupportedError
from ..functions.text import canonical

MAX_HOPS = 40
MAX_COMPONENT = 1024
LINKS = "parent bigint, name string, kind string, target string, target_file string, creation_order bigint"
OBJECTS = "object bigint, kind string"
ATTRS = "owner bigint, name string, creation_order bigint, dtype string, value string"


def members(links: DataFrame, parent: int) -> DataFrame:
    """``name, kind, target`` of a group's links, by name."""
    return links.where(F.col("parent") == parent).select("name", "kind", "target").orderBy("name")


def by_creation(links: DataFrame, parent: int) -> DataFrame:
    """``at, name``: a group's links in the order they were made."""
    at = F.row_number().over(Window.partitionBy("parent").orderBy("creation_order", "name")) - 1
    return links.where(F.col("parent") == parent).select(at.cast("bigint").alias("at"), "name")


def children(links: DataFrame, objects: DataFrame, parent: int, kind: str) -> DataFrame:
    """``name, object`` of the hard-linked children of one kind."""
    mine = links.where((F.col("parent") == parent) & (F.col("kind") == "hard")).select("name", F.col("target").cast("bigint").alias("object"))
    return mine.join(objects.where(F.col("kind") == kind).select("object"), "object", "left_semi").select("name", "object")


def link_counts(links: DataFrame) -> DataFrame:
    """``object, n``: hard links to each object; an object without any is gone."""
    return links.where("kind = 'hard'").groupBy(F.col("target").cast("bigint").alias("object")).agg(F.count("*").alias("n"))


def link_at(links: DataFrame, parent: int, index: int, by: str = "name") -> DataFrame:
    """The link at a place in name or creation order."""
    order = ["name"] if by == "name" else ["creation_order", "name"]
    at = F.row_number().over(Window.partitionBy("parent").orderBy(*order)) - 1
    return links.where(F.col("parent") == parent).withColumn("at", at).where(F.col("at") == index).drop("at")


def exists(links: DataFrame, parent: int, name: str) -> DataFrame:
    return links.where((F.col("parent") == parent) & (F.col("name") == name)).limit(1).agg((F.count("*") > 0).alias("found"))


def attributes(attrs: DataFrame, owner: int, by: str = "name") -> DataFrame:
    """``at, name, dtype, value`` of an object's attributes by name or creation order."""
    order = ["name"] if by == "name" else ["creation_order", "name"]
    at = F.row_number().over(Window.partitionBy("owner").orderBy(*order)) - 1
    return attrs.where(F.col("owner") == owner).select(at.cast("bigint").alias("at"), "name", "dtype", "value")


class Namespace:
    """Path resolution over the link table, one bounded lookup for each step.

    Hard links descend, soft links start again at their path, external links go to another file's
    namespace.  ``..`` is lexical.  At most 40 soft or external links are followed, none twice.
    """

    def __init__(self, links: DataFrame, objects: DataFrame, attrs: DataFrame | None = None, root: int = 0, open_file: Callable[[str], Namespace] | None = None, name: str = "."):
        self.links, self.objects, self.attrs, self.root, self.open_file, self.name = links, objects, attrs, root, open_file, name

    def _step(self, parent: int, name: str):
        rows = self.links.where((F.col("parent") == parent) & (F.col("name") == name)).limit(1).collect()
        if not rows:
            raise FormatError(f"no link {name!r}")
        return rows[0]

    def resolve(self, path: str, base: str = "/") -> tuple[Namespace, int]:
        """(namespace, object) at the end of a path."""
        space, hops, seen = self, 0, set()
        todo = canonical(path if path.startswith("/") else f"{base}/{path}").split("/")[1:]
        at, here = space.root, "/"
        todo = [p for p in todo if p]
        while todo:
            part = todo.pop(0)
            if len(part.encode()) > MAX_COMPONENT:
                raise FormatError("a path component is over 1024 bytes")
            link = space._step(at, part)
            if link.kind == "hard":
                at, here = int(link.target), canonical(f"{here}/{part}")
                continue
            if link.kind not in ("soft", "external"):
                raise UnsupportedError(f"a link of kind {link.kind}")
            hops += 1
            key = (space.name, at, part, tuple(todo))
            if hops > MAX_HOPS or key in seen:
                raise FormatError("links lead in a circle")
            seen.add(key)
            if link.kind == "external":
                if space.open_file is None:
                    raise UnsupportedError("no way to open other files")
                space = space.open_file(link.target_file)
                full = canonical(link.target)
            else:
                full = canonical(link.target if link.target.startswith("/") else f"{here}/{link.target}")
            todo = [p for p in full.split("/") if p] + todo
            at, here = space.root, "/"
        return space, at

    def open(self, path: str, kind: str) -> int:
        space, obj = self.resolve(path)
        found = space.objects.where((F.col("object") == obj) & (F.col("kind") == kind)).limit(1).count()
        if not found:
            raise FormatError(f"{path} is no {kind}")
        return obj

    def list(self, path: str = "/") -> DataFrame:
        space, obj = self.resolve(path)
        return members(space.links, obj)
