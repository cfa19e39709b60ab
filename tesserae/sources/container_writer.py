"""Writing hierarchical binary containers (see :mod:`container`): one process appends blocks to one file.

For results and exchange, not for bulk storage: large arrays belong in a :class:`~.store.Store`.
Freed space is never used again; the superblock is written last.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import prod
from typing import BinaryIO

import numpy as np

from ..errors import FormatError, UnsupportedError
from ..functions.text import canonical
from ..operators.chunks import index_kind
from ..plans.selection import Everything, Hyperslab, Nothing, Points, Selection, Slices
from ..shape import Shape
from . import codecs
from .container import ATTRIBUTE, ATTRIBUTE_INFO, DATASPACE, DATATYPE, EXTERNAL, FILL, FILTERS, LAYOUT, LINK, LINK_INFO, SIGNATURE, SYMBOLS, UNDEFINED

NONE = b"\xff" * 8
u = lambda n, size: int(n).to_bytes(size, "little")


def bits_for(n: int) -> int:
    return (n.bit_length() + 7) // 8


@dataclass(frozen=True)
class VString:
    """Variable-length UTF-8 strings."""


@dataclass(frozen=True)
class Sequence_:
    """Variable-length sequences of a numpy type."""

    base: np.dtype


@dataclass(frozen=True)
class Enum:
    base: np.dtype
    members: tuple[tuple[str, int], ...]


def type_bytes(t) -> bytes:
    """A datatype message."""
    if isinstance(t, VString):
        return u(9 | 1 << 4, 1) + u(1 | 1 << 8, 3) + u(16, 4) + u(3 | 1 << 4, 1) + u(1 << 4, 3) + u(1, 4)
    if isinstance(t, Sequence_):
        return u(9 | 1 << 4, 1) + u(0, 3) + u(16, 4) + type_bytes(t.base)
    if isinstance(t, Enum):
        order = "big" if t.base.byteorder == ">" else "little"
        body = b"".join(n.encode() + b"\0" for n, _ in t.members) + b"".join(int(v).to_bytes(t.base.itemsize, order, signed=t.base.kind == "i") for _, v in t.members)
        return u(8 | 3 << 4, 1) + u(len(t.members), 3) + u(t.base.itemsize, 4) + type_bytes(t.base) + body
    t = np.dtype(t)
    big = int(t.byteorder == ">" or t.byteorder == "=" and not np.little_endian)
    if t.subdtype:
        base, dims = t.subdtype
        return u(10 | 3 << 4, 1) + u(0, 3) + u(t.itemsize, 4) + u(len(dims), 1) + b"".join(u(d, 4) for d in dims) + type_bytes(base)
    if t.names:
        place = max(1, bits_for(t.itemsize))
        body = b"".join(n.encode() + b"\0" + u(t.fields[n][1], place) + type_bytes(t.fields[n][0]) for n in t.names)
        return u(6 | 3 << 4, 1) + u(len(t.names), 3) + u(t.itemsize, 4) + body
    if t.kind in "iub":
        return u(0 | 1 << 4, 1) + u(big | (8 if t.kind == "i" else 0), 3) + u(t.itemsize, 4) + u(0, 2) + u(8 * t.itemsize, 2)
    if t.kind == "f":
        e, m = {2: (5, 10), 4: (8, 23), 8: (11, 52)}[t.itemsize]
        return u(1 | 1 << 4, 1) + u(big | 2 << 4 | (8 * t.itemsize - 1) << 8, 3) + u(t.itemsize, 4) + u(0, 2) + u(8 * t.itemsize, 2) + u(m, 1) + u(e, 1) + u(0, 1) + u(m, 1) + u(2 ** (e - 1) - 1, 4)
    if t.kind == "S":
        return u(3 | 1 << 4, 1) + u(1 | 1 << 4, 3) + u(t.itemsize, 4)
    if t.kind == "V":
        return u(5 | 1 << 4, 1) + u(0, 3) + u(t.itemsize, 4)
    raise UnsupportedError(f"cannot store {t}")


def shape_bytes(s: Shape) -> bytes:
    if s.is_null:
        return bytes([2, 0, 0, 2])
    out = bytes([2, s.rank, int(s.max_dims is not None), int(s.rank > 0)]) + b"".join(u(d, 8) for d in s.dims)
    return out + b"".join(NONE if m is None else u(m, 8) for m in (s.max_dims or ()))


@dataclass
class _Group:
    links: dict[str, tuple[str, object]] = field(default_factory=dict)  # name: kind, target
    attrs: dict[str, tuple[object, np.ndarray]] = field(default_factory=dict)
    dense: bool = False


@dataclass
class _Data:
    values: object
    kind: object
    shape: Shape
    chunk: tuple[int, ...] | None
    filters: tuple[codecs.Filter, ...]
    fill: object
    compact: bool
    only: set | None  # chunks to store, None for all
    attrs: dict[str, tuple[object, np.ndarray]] = field(default_factory=dict)
    external: list | None = None  # (file, offset, size)
    mappings: list | None = None  # (file, dataset, source selection, own selection)


def selection_bytes(s: Selection | list, shape: Shape) -> bytes:
    """A stored selection; a list is of blocks (inclusive corners)."""
    if isinstance(s, list):
        rank = len(s[0][0])
        return u(2, 4) + u(1, 4) + bytes(8) + u(rank, 4) + u(len(s), 4) + b"".join(u(x, 4) for lo, hi in s for x in (*lo, *hi))
    if isinstance(s, (Nothing, Everything)):
        return u(0 if isinstance(s, Nothing) else 3, 4) + u(1, 4) + bytes(8)
    if isinstance(s, Points):
        return u(1, 4) + u(1, 4) + bytes(8) + u(shape.rank, 4) + u(len(s.coords), 4) + b"".join(u(x, 4) for c in s.coords for x in c)
    if isinstance(s, Slices):
        s = s.hyperslab(shape)
    if not isinstance(s, Hyperslab):
        raise UnsupportedError("cannot store this selection")
    return u(2, 4) + u(2, 4) + b"\x01" + bytes(4) + u(len(s.spans), 4) + b"".join(u(x.start, 8) + u(x.stride, 8) + (NONE if x.count is None else u(x.count, 8)) + u(x.block, 8) for x in s.spans)


class ContainerWriter:
    """Groups, datasets, links and attributes are collected, then written by :meth:`close`."""

    def __init__(self, path: str | BinaryIO, old: bool = False, userblock: int = 0, exclusive: bool = False):
        if userblock and (userblock < 512 or userblock & userblock - 1):
            raise FormatError("a user block has 512 bytes or a higher power of two")
        self.path, self.old, self.userblock = path, old, userblock
        self.file = open(path, "xb" if exclusive else "wb") if isinstance(path, str) else path
        self.file.write(bytes(userblock))
        self.at = 0
        self.alloc(b"\0" * 96)
        self.objects: dict[int, _Group | _Data] = {0: _Group()}

    def __enter__(self) -> ContainerWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()
        elif isinstance(self.path, str):
            self.file.close()

    def alloc(self, data: bytes) -> int:
        """Appends a block at a multiple of 8 bytes; its address."""
        pad = -self.at % 8
        self.file.seek(self.userblock + self.at)
        self.file.write(bytes(pad) + data)
        at = self.at + pad
        self.at = at + len(data)
        return at

    # content

    def _place(self, path: str) -> tuple[_Group, str]:
        parts = canonical(path).split("/")[1:]
        at: _Group | _Data = self.objects[0]
        for p in parts[:-1]:
            kind, target = at.links.get(p, ("", None)) if isinstance(at, _Group) else ("", None)
            if kind != "hard":
                raise FormatError(f"no group {p!r}")
            at = self.objects[target]
        if not parts[-1] or not isinstance(at, _Group):
            raise FormatError(f"nothing can be put at {path!r}")
        if parts[-1] in at.links:
            raise FormatError(f"{path} exists")
        return at, parts[-1]

    def _find(self, path: str) -> int:
        at = 0
        for p in [p for p in canonical(path).split("/") if p]:
            kind, at = self.objects[at].links[p]
            if kind != "hard":
                raise FormatError("only hard links can be followed while writing")
        return at

    def _add(self, path: str, what: _Group | _Data) -> None:
        group, name = self._place(path)
        n = len(self.objects)
        self.objects[n] = what
        group.links[name] = ("hard", n)

    def group(self, path: str, dense: bool = False) -> None:
        self._add(path, _Group(dense=dense))

    def soft(self, path: str, target: str) -> None:
        group, name = self._place(path)
        group.links[name] = ("soft", target)

    def external(self, path: str, file: str, target: str) -> None:
        group, name = self._place(path)
        group.links[name] = ("external", (file, target))

    def hard(self, path: str, target: str) -> None:
        group, name = self._place(path)
        group.links[name] = ("hard", self._find(target))

    def attr(self, path: str, name: str, value: object, kind: object = None) -> None:
        attrs = self.objects[self._find(path)].attrs
        if name in attrs:
            raise FormatError(f"attribute {name} exists")
        if isinstance(value, str) or isinstance(value, (list, tuple)) and value and all(isinstance(x, str) for x in value):
            attrs[name] = (kind or VString(), np.array(value, object))
        else:
            attrs[name] = (kind or np.asarray(value).dtype, np.asarray(value))

    def dataset(self, path: str, values, kind: object = None, *, dims: Sequence[int] | None = None, max_dims=None, chunk=None, filters: Sequence[codecs.Filter] = (), fill=None, compact: bool = False, only=None) -> None:
        """``values``: an array, or None to store nothing and read the fill value.  ``only``: chunk numbers to store."""
        if values is not None and kind is None:
            a = np.asarray(values)
            kind = VString() if a.dtype.kind in "UO" else a.dtype
        if values is None and dims is None:
            raise FormatError("a dataset without values needs its dimensions")
        shape = Shape(tuple(dims) if dims is not None else np.asarray(values, object if not isinstance(kind, np.dtype) else None).shape, tuple(max_dims) if max_dims is not None else None)
        if shape.is_resizable and not chunk:
            raise FormatError("an array that can grow needs chunks")
        if filters and not chunk:
            raise FormatError("filters need chunks")
        if compact and chunk:
            raise FormatError("compact data have no chunks")
        self._add(path, _Data(values, kind, shape, tuple(chunk) if chunk else None, tuple(filters), fill, compact, set(map(tuple, only)) if only is not None else None))

    def external_dataset(self, path: str, kind, dims: Sequence[int], pieces: Sequence[tuple[str, int, int]]) -> None:
        """A dataset whose bytes are in other files: (name, offset, size), joined in order."""
        self._add(path, _Data(None, np.dtype(kind), Shape(tuple(dims)), None, (), None, False, None, external=list(pieces)))

    def virtual_dataset(self, path: str, kind, dims: Sequence[int], mappings: Sequence[tuple[str, str, object, object]], fill=None, max_dims=None) -> None:
        """A dataset made of others: (file, dataset, source selection, own selection)."""
        self._add(path, _Data(None, np.dtype(kind), Shape(tuple(dims), tuple(max_dims) if max_dims is not None else None), None, (), fill, False, None, mappings=list(mappings)))

    # headers

    def _header(self, messages: list[tuple[int, bytes]]) -> int:
        if self.old:
            body = b""
            for kind, b in messages:
                b += bytes(-len(b) % 8)
                body += u(kind, 2) + u(len(b), 2) + bytes(4) + b
            return self.alloc(u(1, 1) + bytes(1) + u(len(messages), 2) + u(1, 4) + u(len(body), 4) + bytes(4) + body)
        body = b"".join(u(kind, 1) + u(len(b), 2) + bytes(1) + b for kind, b in messages)
        out = b"OHDR" + bytes([2, 2]) + u(len(body), 4) + body
        return self.alloc(out + u(codecs.lookup3(out), 4))

    def _signed(self, data: bytes) -> int:
        return self.alloc(data + u(codecs.lookup3(data), 4))

    def _encode(self, kind, values: np.ndarray) -> bytes:
        """Element bytes; variable-length ones go to a global heap."""
        flat = np.asarray(values, object if isinstance(kind, (VString, Sequence_)) else None).ravel()
        if isinstance(kind, (VString, Sequence_)):
            bodies = [(str(v).encode(), len(str(v).encode())) if isinstance(kind, VString) else (np.asarray(v, kind.base).tobytes(), len(v)) for v in flat]
            out, batch = [], []
            for b in bodies + [None]:
                if b is None or len(batch) == 60_000:
                    body = b"".join(u(i, 2) + u(1, 2) + bytes(4) + u(len(x), 8) + x + bytes(-len(x) % 8) for i, (x, _) in enumerate(batch, 1))
                    size = max(4096, 16 + len(body) + 16)
                    free = size - 16 - len(body)
                    at = self.alloc(b"GCOL" + u(1, 1) + bytes(3) + u(size, 8) + body + u(0, 2) + bytes(6) + u(free, 8) + bytes(free - 16)) if batch else 0
                    out += [u(n, 4) + u(at, 8) + u(i, 4) for i, (_, n) in enumerate(batch, 1)]
                    batch = []
                if b is not None:
                    batch.append(b)
            return b"".join(out)
        t = kind.base if isinstance(kind, Enum) else np.dtype(kind)
        return np.ascontiguousarray(flat.astype(t.subdtype[0] if t.subdtype else t)).tobytes()

    def _size(self, kind) -> int:
        return 16 if isinstance(kind, (VString, Sequence_)) else kind.base.itemsize if isinstance(kind, Enum) else np.dtype(kind).itemsize

    def _attribute(self, name: str, kind, value: np.ndarray) -> bytes:
        n, t, s = name.encode() + b"\0", type_bytes(kind), shape_bytes(Shape(value.shape))
        data = self._encode(kind, value)
        if self.old:
            pad = lambda b: b + bytes(-len(b) % 8)
            return bytes([1, 0]) + u(len(n), 2) + u(len(t), 2) + u(len(s), 2) + pad(n) + pad(t) + pad(s) + data
        return bytes([3, 0]) + u(len(n), 2) + u(len(t), 2) + u(len(s), 2) + b"\x01" + n + t + s + data

    def _attributes(self, attrs: dict, dense: bool) -> list[tuple[int, bytes]]:
        bodies = [(n, self._attribute(n, k, v)) for n, (k, v) in attrs.items()]
        if not dense:
            return [(ATTRIBUTE, b) for _, b in bodies]
        heap, ids = self._heap([b for _, b in bodies], 40, 8)
        records = sorted((codecs.lookup3(n.encode()), k, i) for (i, (n, _)), k in zip(enumerate(bodies), ids))
        tree = self._tree2(8, [k + bytes(1) + u(i, 4) + u(h, 4) for h, k, i in records])
        return [(ATTRIBUTE_INFO, bytes([0, 0]) + u(heap, 8) + u(tree, 8))]

    def _link(self, name: str, kind: str, target, where: dict[int, int]) -> bytes:
        n = name.encode()
        flags = 0x10 | (0 if kind == "hard" else 8) | (0 if len(n) < 256 else 1)
        head = bytes([1, flags]) + (b"" if kind == "hard" else bytes([1 if kind == "soft" else 64])) + b"\x01" + u(len(n), 1 if len(n) < 256 else 2) + n
        if kind == "hard":
            return head + u(where[target], 8)
        raw = target.encode() if kind == "soft" else b"\0" + target[0].encode() + b"\0" + target[1].encode() + b"\0"
        return head + u(len(raw), 2) + raw

    def _group(self, g: _Group, where: dict[int, int]) -> int:
        messages = self._attributes(g.attrs, g.dense)
        if self.old:
            if any(k == "external" for k, _ in g.links.values()):
                raise UnsupportedError("old groups have no external links")
            return self._header([(SYMBOLS, self._symbols(g, where)), *messages])
        if not g.dense:
            return self._header([(LINK_INFO, bytes([0, 0]) + NONE + NONE), *[(LINK, self._link(n, k, t, where)) for n, (k, t) in g.links.items()], *messages])
        bodies = [(n, self._link(n, k, t, where)) for n, (k, t) in g.links.items()]
        heap, ids = self._heap([b for _, b in bodies], 32, 7)
        records = sorted((codecs.lookup3(n.encode()), k) for (n, _), k in zip(bodies, ids))
        tree = self._tree2(5, [u(h, 4) + k for h, k in records])
        return self._header([(LINK_INFO, bytes([0, 0]) + u(heap, 8) + u(tree, 8)), *messages])

    def _symbols(self, g: _Group, where: dict[int, int]) -> bytes:
        names, entries = bytes(8), b""
        for n, (kind, target) in sorted(g.links.items(), key=lambda x: x[0].encode()):
            at = len(names)
            names += n.encode() + b"\0"
            names += bytes(-len(names) % 8)
            if kind == "soft":
                value = len(names)
                names += target.encode() + b"\0"
                names += bytes(-len(names) % 8)
                entries += u(at, 8) + NONE + u(2, 4) + bytes(4) + u(value, 4) + bytes(12)
            else:
                entries += u(at, 8) + u(where[target], 8) + bytes(24)
        data = self.alloc(names)
        heap = self.alloc(b"HEAP" + bytes(4) + u(len(names), 8) + u(1, 8) + u(data, 8))
        snod = self.alloc(b"SNOD" + bytes([1, 0]) + u(len(g.links), 2) + entries)
        tree = self.alloc(b"TREE" + bytes([0, 0]) + u(1 if g.links else 0, 2) + NONE + NONE + u(0, 8) + u(snod, 8) + u(len(names) - 8, 8))
        return u(tree, 8) + u(heap, 8)

    # fractal heap and version 2 tree

    def _heap(self, objects: list[bytes], bits: int, id_size: int) -> tuple[int, list[bytes]]:
        """Objects in direct blocks under one indirect block (or one direct block alone); the heap's address and an id for each."""
        width, first, direct, most = 4, 512, 65536, 4096
        offset_size, length_size = (bits + 7) // 8, bits_for(min(direct, most))
        head = 5 + 8 + offset_size
        if any(len(b) > most for b in objects):
            raise UnsupportedError("an object is too large for a group's heap")
        direct_rows = (direct // first).bit_length() + 1
        sizes = [first << max(0, r - 1) for r in range(direct_rows) for _ in range(width)]
        blocks: list[bytearray] = [bytearray()]
        starts, ids = [0], []
        for b in objects:
            while head + len(blocks[-1]) + len(b) > sizes[len(blocks) - 1]:
                starts.append(starts[-1] + sizes[len(blocks) - 1])
                blocks.append(bytearray())
                if len(blocks) > len(sizes):
                    raise UnsupportedError("too many objects for direct blocks")
            at = starts[-1] + head + len(blocks[-1])
            blocks[-1] += b
            ids.append((bytes(1) + u(at, offset_size) + u(len(b), length_size)).ljust(id_size, b"\0"))
        heap = self.alloc(bytes(146))  # filled in below: blocks point to it
        places = [self.alloc((b"FHDB" + bytes(1) + u(heap, 8) + u(s, offset_size) + bytes(b)).ljust(n, b"\0")) for b, s, n in zip(blocks, starts, sizes)]
        rows = -(-len(blocks) // width) if len(blocks) > 1 else 0
        root = places[0]
        if rows:
            root = self._signed(b"FHIB" + bytes(1) + u(heap, 8) + u(0, offset_size) + b"".join(u(p, 8) for p in places) + NONE * (rows * width - len(places)))
        space = sum(sizes[: len(blocks)])
        body = b"FRHP" + bytes(1) + u(id_size, 2) + u(0, 2) + bytes(1) + u(most, 4) + u(0, 8) + NONE + u(0, 8) + NONE + u(space, 8) + u(space, 8) + u(space, 8) + u(len(objects), 8) + bytes(32)
        body += u(width, 2) + u(first, 8) + u(direct, 8) + u(bits, 2) + u(1, 2) + u(root, 8) + u(rows, 2)
        self.file.seek(self.userblock + heap)
        self.file.write(body + u(codecs.lookup3(body), 4))
        return heap, ids

    def _tree2(self, kind: int, records: list[bytes]) -> int:
        """A version 2 tree of one or two levels."""
        size = len(records[0]) if records else 11
        node = 512
        while True:
            leaf = (node - 10) // size
            pointer = 8 + bits_for(leaf)
            inner = (node - 10 - pointer) // (size + pointer)
            if len(records) <= leaf * (inner + 1) or len(records) <= leaf:
                break
            node *= 2
        put = lambda r: self._signed(b"BTLF" + bytes([0, kind]) + b"".join(r))
        if len(records) <= leaf:
            root, n, depth = (put(records) if records else UNDEFINED), len(records), 0
        else:
            n_leaves = -(-(len(records) + 1) // (leaf + 1))
            per, leaves, between, at = -(-(len(records) - n_leaves + 1) // n_leaves), [], [], 0
            while at < len(records):
                part = records[at : at + per]
                leaves.append(part)
                at += len(part)
                if at < len(records) - 1:
                    between.append(records[at])
                    at += 1
                elif at < len(records):
                    part.append(records[at])
                    at += 1
            body = b"BTIN" + bytes([0, kind]) + b"".join(between) + b"".join(u(put(p), 8) + u(len(p), bits_for(leaf)) for p in leaves)
            root, n, depth = self._signed(body), len(between), 1
        head = b"BTHD" + bytes([0, kind]) + u(node, 4) + u(size, 2) + u(depth, 2) + bytes([100, 40]) + (NONE if root == UNDEFINED else u(root, 8)) + u(n, 2) + u(len(records), 8)
        return self._signed(head)

    # datasets

    def _data(self, d: _Data) -> int:
        size = self._size(d.kind)
        fill = b""
        if d.fill is not None:
            fill = self._encode(d.kind, np.asarray(d.fill))
        messages = [(DATASPACE, shape_bytes(d.shape)), (DATATYPE, type_bytes(d.kind)), (FILL, bytes([3, 2 | 2 << 2 | (0x20 if fill else 0)]) + (u(len(fill), 4) + fill if fill else b""))]
        if d.external is not None:
            names = bytes(8)
            slots = b""
            for name, at, n in d.external:
                slots += u(len(names), 8) + u(at, 8) + u(n, 8)
                names += name.encode() + b"\0"
                names += bytes(-len(names) % 8)
            heap = self.alloc(b"HEAP" + bytes(4) + u(len(names), 8) + u(1, 8) + u(self.alloc(names), 8))
            messages.append((EXTERNAL, bytes([1, 0, 0, 0]) + u(len(d.external), 2) * 2 + u(heap, 8) + slots))
            messages.append((LAYOUT, bytes([3, 1]) + NONE + u(d.shape.size * size, 8)))
        elif d.mappings is not None:
            body = bytes(1) + u(len(d.mappings), 8)
            for file, name, src, dst in d.mappings:
                body += file.encode() + b"\0" + name.encode() + b"\0" + selection_bytes(src, d.shape) + selection_bytes(dst, d.shape)
            body += u(codecs.lookup3(body), 4)
            heap = 16 + 16 + len(body) + -len(body) % 8 + 16
            at = self.alloc(b"GCOL" + u(1, 1) + bytes(3) + u(heap, 8) + u(1, 2) + u(1, 2) + bytes(4) + u(len(body), 8) + body + bytes(-len(body) % 8) + bytes(16))
            messages.append((LAYOUT, bytes([4, 3]) + u(at, 8) + u(1, 4)))
        elif d.chunk:
            if d.filters:
                messages.append((FILTERS, self._filters(d, size)))
            messages.append((LAYOUT, self._chunked(d, size, fill)))
        else:
            raw = b"" if d.values is None else self._encode(d.kind, np.asarray(d.values, object if isinstance(d.kind, (VString, Sequence_)) else None))
            if d.values is not None and len(raw) != d.shape.size * size:
                raise FormatError("as many elements as the shape has are needed")
            if d.compact:
                raw = raw or (fill or bytes(size)) * d.shape.size
                messages.append((LAYOUT, bytes([3, 0]) + u(len(raw), 2) + raw))
            else:
                messages.append((LAYOUT, bytes([3, 1]) + (u(self.alloc(raw), 8) if raw else NONE) + u(d.shape.size * size, 8)))
        return self._header(messages + self._attributes(d.attrs, False))

    def _filters(self, d: _Data, size: int) -> bytes:
        out = bytes([2, len(d.filters)])
        for f in d.filters:
            number = {"deflate": 1, "shuffle": 2, "fletcher32": 3}.get(f.name)
            if number is None:
                raise UnsupportedError(f"cannot write filter {f.name}")
            values = {"deflate": [f.options.get("level", 6)], "shuffle": [size], "fletcher32": []}[f.name]
            out += u(number, 2) + u(0, 2) + u(len(values), 2) + b"".join(u(v, 4) for v in values)
        return out

    def _chunks(self, d: _Data, size: int, fill: bytes) -> list[tuple[tuple[int, ...], int, int]]:
        """(chunk number on each axis, address, stored bytes) of the chunks to store."""
        if d.values is None:
            return []
        whole = np.frombuffer(self._encode(d.kind, np.asarray(d.values, object if isinstance(d.kind, (VString, Sequence_)) else None)), np.dtype(f"V{size}"))
        if len(whole) != d.shape.size:
            raise FormatError("as many elements as the shape has are needed")
        whole = whole.reshape(d.shape.dims)
        pipeline = codecs.Pipeline(tuple(codecs.Filter(f.name, {**f.options, "size": size}) for f in d.filters))
        out = []
        for k in np.ndindex(*[-(-n // c) for n, c in zip(d.shape.dims, d.chunk)]):
            if d.only is not None and k not in d.only:
                continue
            block = np.frombuffer((fill or bytes(size)) * prod(d.chunk), whole.dtype).reshape(d.chunk).copy()
            part = whole[tuple(slice(i * c, (i + 1) * c) for i, c in zip(k, d.chunk))]
            block[tuple(slice(0, n) for n in part.shape)] = part
            raw = pipeline.encode(block.tobytes())
            out.append((k, self.alloc(raw), len(raw)))
        return out

    def _chunked(self, d: _Data, size: int, fill: bytes) -> bytes:
        stored = self._chunks(d, size, fill)
        rank, chunk_bytes = d.shape.rank, prod(d.chunk) * size
        if self.old:
            keys = b"".join(u(n, 4) + bytes(4) + b"".join(u(i * c, 8) for i, c in zip(k, d.chunk)) + bytes(8) + u(at, 8) for k, at, n in stored)
            tree = self.alloc(b"TREE" + bytes([1, 0]) + u(len(stored), 2) + NONE + NONE + keys + bytes(8 + 8 * rank + 8)) if stored else UNDEFINED
            return bytes([3, 2, rank + 1]) + (NONE if tree == UNDEFINED else u(tree, 8)) + b"".join(u(c, 4) for c in d.chunk) + u(size, 4)
        width = max(bits_for(c) for c in (*d.chunk, size))
        kind = index_kind(d.shape, d.chunk)
        size_bytes = min(8, 1 + (chunk_bytes.bit_length() - 1 + 8) // 8)
        element = lambda at, n: u(at, 8) + (u(n, size_bytes) + bytes(4) if d.filters else b"")
        empty = NONE + (bytes(size_bytes + 4) if d.filters else b"")
        grid = [-(-n // c) for n, c in zip(d.shape.dims, d.chunk)]
        head = bytes([4, 2, 2 if kind == "single chunk" and d.filters else 0, rank + 1, width]) + b"".join(u(c, width) for c in (*d.chunk, size))
        if kind == "single chunk":
            extra = (u(stored[0][2] if stored else 0, 8) + bytes(4)) if d.filters else b""
            return head + b"\x01" + extra + (u(stored[0][1], 8) if stored else NONE)
        if kind == "fixed array":
            by = {int(np.ravel_multi_index(k, grid)): element(at, n) for k, at, n in stored}
            return head + b"\x03" + bytes([10]) + u(self._fixed(by, prod(grid), empty, bool(d.filters)), 8)
        if kind == "extensible array":
            grow = next(i for i, m in enumerate(d.shape.max_dims) if m is None)
            order = [grow, *(i for i in range(rank) if i != grow)]
            by = {int(np.ravel_multi_index([k[i] for i in order], [grid[i] for i in order])): element(at, n) for k, at, n in stored}
            return head + b"\x04" + bytes([32, 4, 4, 16, 10]) + u(self._extensible(by, empty, bool(d.filters)), 8)
        records = [element(at, n) + b"".join(u(i, 8) for i in k) for k, at, n in sorted(stored)]
        return head + b"\x05" + u(2048, 4) + bytes([100, 40]) + u(self._tree2(11 if d.filters else 10, records), 8)

    def _fixed(self, by: dict[int, bytes], count: int, empty: bytes, filtered: bool) -> int:
        client, page = bytes([0, int(filtered)]), 1024
        head = self.alloc(bytes(28))
        if count <= page:
            block = self._signed(b"FADB" + client + u(head, 8) + b"".join(by.get(i, empty) for i in range(count)))
        else:
            pages = -(-count // page)
            used = {i // page for i in by}
            bitmap = bytearray((pages + 7) // 8)
            for p in used:
                bitmap[p // 8] |= 0x80 >> p % 8
            body = b"FADB" + client + u(head, 8) + bytes(bitmap)
            body += u(codecs.lookup3(body), 4)
            for p in range(pages):
                part = b"".join(by.get(i, empty) for i in range(p * page, min(count, (p + 1) * page)))
                body += part + u(codecs.lookup3(part), 4)
            block = self.alloc(body)
        data = b"FAHD" + client + bytes([len(empty), 10]) + u(count, 8) + u(block, 8)
        self.file.seek(self.userblock + head)
        self.file.write(data + u(codecs.lookup3(data), 4))
        return head

    def _extensible(self, by: dict[int, bytes], empty: bytes, filtered: bool) -> int:
        client, bits, in_index, least, pointers, page = bytes([0, int(filtered)]), 32, 4, 16, 4, 1024
        head = self.alloc(bytes(72))
        n_super, direct = 1 + bits - (least.bit_length() - 1), 2 * (pointers.bit_length() - 1)
        supers = [(1 << k // 2, least << (k + 1) // 2) for k in range(n_super)]
        top = max(by, default=-1)

        def block(first: int, n: int) -> bytes:
            if first > top or not any(i in by for i in range(first, first + n)):
                return NONE
            lead = b"EADB" + client + u(head, 8) + u(first - in_index, bits // 8)
            cells = lambda a, b: b"".join(by.get(i, empty) for i in range(a, b))
            if n <= page:
                return u(self._signed(lead + cells(first, first + n)), 8)
            body = lead + u(codecs.lookup3(lead), 4)
            for p in range(n // page):
                part = cells(first + p * page, first + (p + 1) * page)
                body += part + u(codecs.lookup3(part), 4)
            return u(self.alloc(body), 8)

        index = b"EAIB" + client + u(head, 8) + b"".join(by.get(i, empty) for i in range(in_index))
        first = in_index
        for k, (n, size) in enumerate(supers):
            if k < direct:
                for _ in range(n):
                    index += block(first, size)
                    first += size
                continue
            if first > top:
                index += NONE
                first += n * size
                continue
            start, places = first, []
            for _ in range(n):
                places.append(block(first, size))
                first += size
            maps = (bytes([0xFF] * ((size // page + 7) // 8)) * n) if size > page else b""
            index += u(self._signed(b"EASB" + client + u(head, 8) + u(start - in_index, bits // 8) + maps + b"".join(places)), 8)
        at = self._signed(index)
        data = b"EAHD" + client + bytes([len(empty), bits, in_index, least, pointers, 10]) + bytes(32) + u(top + 1, 8) + u(top + 1, 8) + u(at, 8)
        self.file.seek(self.userblock + head)
        self.file.write(data + u(codecs.lookup3(data), 4))
        return head

    def close(self) -> None:
        where: dict[int, int] = {n: self._data(x) for n, x in self.objects.items() if isinstance(x, _Data)}

        def put(n: int, path: tuple[int, ...] = ()) -> int:
            if n not in where:
                if n in path:
                    raise UnsupportedError("hard links in a circle")
                g = self.objects[n]
                for kind, target in g.links.values():
                    if kind == "hard":
                        put(target, (*path, n))
                where[n] = self._group(g, where)
            return where[n]

        root = put(0)
        end = self.at
        base = u(self.userblock, 8)
        if self.old:
            data = SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + u(32767, 2) + u(16, 2) + bytes(4) + base + NONE + u(self.userblock + end, 8) + NONE + u(0, 8) + u(root, 8) + bytes(24)
        else:
            data = SIGNATURE + bytes([2, 8, 8, 0]) + base + NONE + u(self.userblock + end, 8) + u(root, 8)
            data += u(codecs.lookup3(data), 4)
        self.file.seek(self.userblock)
        self.file.write(data)
        if isinstance(self.path, str):
            self.file.close()
