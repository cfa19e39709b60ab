"""Reading hierarchical binary containers: the open self-describing format with signature ``\\x89HDF``.

Written from the public format specification.  The driver parses metadata only: superblock, object
headers, groups, attributes and chunk indexes.  A dataset becomes a list of pieces (address, stored
bytes, filter mask, place), which tasks read and decode on their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs

from ..errors import FormatError, UnsupportedError
from ..functions.convert import plain_as
from ..functions.text import canonical
from ..plans.selection import Everything, Hyperslab, Nothing, Points, Selection, Span
from ..shape import Shape
from .codecs import REGISTRY, Bits, Filter, Pipeline, lookup3, unpack_bits

SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEFINED = (1 << 64) - 1
MAX_HOPS, MAX_DEPTH = 40, 64

# message types of object headers (fixed values of the format)
DATASPACE, LINK_INFO, DATATYPE, OLD_FILL, FILL, LINK, EXTERNAL, LAYOUT = 1, 2, 3, 4, 5, 6, 7, 8
FILTERS, ATTRIBUTE, CONTINUATION, SYMBOLS, ATTRIBUTE_INFO = 0xB, 0xC, 0x10, 0x11, 0x15


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    fs, p = locate(path)
    return fs.get_file_info(p).type == pafs.FileType.File


def names_in(folder: str) -> list[str]:
    """The files of a folder; none where it does not exist."""
    fs, p = locate(folder)
    return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)) if i.type == pafs.FileType.File)


class Bytes:
    """Random access to a file through an Arrow file system, in cached blocks."""

    BLOCK = 1 << 18

    def __init__(self, path: str | bytes, keep: int = 64):
        try:
            if isinstance(path, bytes):
                path, self.file = "bytes", pa.BufferReader(path)
                self.size, self.keep, self.blocks = self.file.size(), keep, {}
                return
            fs, p = locate(path)
            self.file = fs.open_input_file(p)
        except OSError as e:
            raise FormatError(f"cannot open {path}: {e}") from e
        self.size, self.keep, self.blocks = self.file.size(), keep, {}

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise FormatError(f"bytes {at}..{at + n} are outside the file")
        if n > self.BLOCK:
            return self.file.read_at(n, at)
        first, last = at // self.BLOCK, (at + n - 1) // self.BLOCK if n else at // self.BLOCK
        if first == last:
            return self._block(first)[at - first * self.BLOCK : at - first * self.BLOCK + n]
        out = b"".join(self._block(k) for k in range(first, last + 1))
        return out[at - first * self.BLOCK :][:n]

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            if len(self.blocks) >= self.keep:
                self.blocks.pop(next(iter(self.blocks)))
            at = k * self.BLOCK
            self.blocks[k] = self.file.read_at(min(self.BLOCK, self.size - at), at)
        return self.blocks[k]


class Cursor:
    """Little-endian fields of a piece of metadata."""

    def __init__(self, data: bytes, offsets: int = 8, lengths: int = 8, at: int = 0):
        self.data, self.offsets, self.lengths, self.at = data, offsets, lengths, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError("metadata end too soon")
        self.at += n
        return self.data[self.at - n : self.at]

    def num(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def offset(self) -> int:
        v = self.num(self.offsets)
        return UNDEFINED if v == (1 << 8 * self.offsets) - 1 else v

    def length(self) -> int:
        return self.num(self.lengths)

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise FormatError("a name does not end")
        raw = self.take(end - self.at)
        self.at += 1
        return raw.decode()

    def sign(self, want: bytes) -> None:
        if self.take(len(want)) != want:
            raise FormatError(f"no {want.decode()} block where one should be")

    def align(self, n: int, base: int = 0) -> None:
        self.at += -(self.at - base) % n

    @property
    def left(self) -> int:
        return len(self.data) - self.at


@dataclass(frozen=True)
class Type:
    """A stored element type."""

    kind: str  # int, float, time, string, bits, opaque, compound, reference, enum, sequence, vstring, array
    size: int
    signed: bool = False
    big: bool = False
    precision: int = 0
    bit_offset: int = 0
    padding: int = 0
    members: tuple = ()  # compound: (name, offset, Type); enum: (name, value)
    base: Type | None = None
    dims: tuple[int, ...] = ()
    tag: str = ""
    layout: tuple[int, ...] = ()  # float: exponent place and size, mantissa place and size, bias

    @property
    def dtype(self) -> np.dtype:
        """The numpy type of the stored bytes."""
        order = ">" if self.big else "<"
        if self.kind in ("int", "time", "bits") and self.size in (1, 2, 4, 8):
            return np.dtype(f"{order}{'i' if self.kind == 'int' and self.signed else 'u'}{self.size}")
        if self.kind == "float" and self.size in (2, 4, 8):
            return np.dtype(f"{order}f{self.size}")
        if self.kind == "enum":
            return self.base.dtype
        if self.kind == "reference" and self.size == 8:
            return np.dtype("<u8")
        if self.kind == "compound":
            return np.dtype({"names": [m[0] for m in self.members], "formats": [m[2].dtype for m in self.members], "offsets": [m[1] for m in self.members], "itemsize": self.size})
        if self.kind == "array":
            return np.dtype((self.base.dtype, self.dims))
        return np.dtype(f"V{self.size}")

    def spark(self) -> str:
        """The Spark type: unsigned numbers take the next wider signed one."""
        if self.kind in ("int", "time", "bits"):
            signed = self.kind == "int" and self.signed
            by = {1: "tinyint", 2: "smallint", 4: "int", 8: "bigint"} if signed else {1: "smallint", 2: "int", 4: "bigint", 8: "decimal(20,0)"}
            return by.get(self.size, "binary")
        if self.kind == "float":
            return {2: "float", 4: "float", 8: "double"}.get(self.size, "binary")
        if self.kind in ("string", "vstring"):
            return "string"
        if self.kind == "enum":
            return self.base.spark()
        if self.kind == "reference":
            return "bigint" if self.size == 8 else "binary"
        if self.kind == "compound":
            return "struct<" + ",".join(f"`{n}`:{t.spark()}" for n, _, t in self.members) + ">"
        if self.kind in ("array", "sequence"):
            return f"array<{self.base.spark()}>"
        return "binary"


def read_type(c: Cursor, depth: int = 0) -> Type:
    if depth > MAX_DEPTH:
        raise FormatError("a datatype is nested too deeply")
    head, bits = c.num(1), c.num(3)
    kind, version, size = head & 15, head >> 4, c.num(4)
    if kind in (0, 4):
        place, precision = c.num(2), c.num(2)
        return Type("int" if kind == 0 else "bits", size, bool(bits & 8) and kind == 0, bool(bits & 1), precision, place)
    if kind == 1:
        place, precision, *layout = c.num(2), c.num(2), c.num(1), c.num(1), c.num(1), c.num(1), c.num(4)
        return Type("float", size, True, bool(bits & 1), precision, place, layout=tuple(layout))
    if kind == 2:
        return Type("time", size, False, bool(bits & 1), c.num(2))
    if kind == 3:
        return Type("string", size, padding=bits & 15)
    if kind == 5:
        return Type("opaque", size, tag=c.take(bits & 255).split(b"\0")[0].decode())
    if kind == 6:
        members = []
        for _ in range(bits & 0xFFFF):
            at = c.at
            name = c.text()
            if version < 3:
                c.align(8, at)
                place = c.num(4)
            else:
                place = c.num(max(1, (size.bit_length() + 7) // 8))
            dims: tuple[int, ...] = ()
            if version == 1:
                rank = c.num(1)
                c.take(3 + 4 + 4)
                dims = tuple(c.num(4) for _ in range(4))[:rank]
            t = read_type(c, depth + 1)
            members.append((name, place, Type("array", t.size * prod(dims), base=t, dims=dims) if dims else t))
        spans = sorted((p, p + t.size) for _, p, t in members)
        if len({m[0] for m in members}) != len(members) or any(a[1] > b[0] for a, b in zip(spans, spans[1:])) or spans and spans[-1][1] > size:
            raise FormatError("compound members repeat or overlap")
        return Type("compound", size, members=tuple(members))
    if kind == 7:
        return Type("reference", size)
    if kind == 8:
        base = read_type(c, depth + 1)
        names = []
        for _ in range(bits & 0xFFFF):
            at = c.at
            names.append(c.text())
            if version < 3:
                c.align(8, at)
        order = "big" if base.big else "little"
        values = [int.from_bytes(c.take(base.size), order, signed=base.signed) for _ in names]
        return Type("enum", size, base=base, members=tuple(zip(names, values)))
    if kind == 9:
        return Type("vstring" if bits & 15 == 1 else "sequence", size, padding=bits >> 4 & 15, base=read_type(c, depth + 1))
    if kind == 10:
        rank = c.num(1)
        if version < 3:
            c.take(3)
        dims = tuple(c.num(4) for _ in range(rank))
        if version < 3:
            c.take(4 * rank)
        return Type("array", size, base=read_type(c, depth + 1), dims=dims)
    raise UnsupportedError(f"datatype class {kind}")


def read_shape(c: Cursor) -> Shape:
    version, rank, flags = c.num(1), c.num(1), c.num(1)
    if version == 1:
        c.take(5)
        null = False
    elif version == 2:
        null = c.num(1) == 2
    else:
        raise UnsupportedError(f"dataspace version {version}")
    if null:
        return Shape.null()
    dims = tuple(c.length() for _ in range(rank))
    most = None
    if flags & 1:
        unlimited = (1 << 8 * c.lengths) - 1
        most = tuple(None if (m := c.length()) == unlimited else m for _ in range(rank))
    return Shape(dims, most)


#: Filter numbers of the format.
FILTER_NAMES = {1: "deflate", 2: "shuffle", 3: "fletcher32", 4: "szip", 5: "nbit", 6: "scaleoffset", 32000: "lzf", 32001: "blosc"}


def read_filters(c: Cursor) -> list[tuple[str, list[int]]]:
    version, n = c.num(1), c.num(1)
    if version == 1:
        c.take(6)
    out = []
    for _ in range(n):
        number = c.num(2)
        name_size = c.num(2) if version == 1 or number >= 256 else 0
        c.take(2)
        count = c.num(2)
        c.take(name_size + (-name_size % 8 if version == 1 else 0))
        values = [c.num(4) for _ in range(count)]
        if version == 1 and count % 2:
            c.take(4)
        out.append((FILTER_NAMES.get(number, str(number)), values))
    return out


@dataclass(frozen=True)
class Piece:
    """Stored bytes of a dataset: where, how many, skipped filters, first element on each axis."""

    at: int
    size: int
    mask: int
    start: tuple[int, ...]


@dataclass
class Link:
    name: str
    kind: str  # hard, soft, external, or user
    target: object
    order: int = 0


@dataclass
class Header:
    """The messages of one object."""

    at: int
    messages: list[tuple[int, bytes, int]]  # type, body, flags
    times: tuple[int, ...] = ()

    def first(self, kind: int) -> bytes | None:
        return next((b for k, b, _ in self.messages if k == kind), None)


class Container:
    """An open file."""

    def __init__(self, path: str | bytes, opener: Callable[[str], Container] | None = None):
        self.path, self.bytes = path if isinstance(path, str) else "", Bytes(path)
        self._open = opener or (lambda p: Container(p))
        at = 0
        while at + 8 <= self.bytes.size and self.bytes.read(at, 8) != SIGNATURE:
            at = 512 if at == 0 else at * 2
        if at + 8 > self.bytes.size:
            raise FormatError("not a container: no signature")
        self.userblock = at
        c = Cursor(self.bytes.read(at, min(256, self.bytes.size - at)), at=8)
        self.version = c.num(1)
        if self.version in (0, 1):
            c.take(4)
            self.offsets, self.lengths = c.num(1), c.num(1)
            c.take(1 + 4 + 4 + (4 if self.version == 1 else 0))
            c.offsets, c.lengths = self.offsets, self.lengths
            self.base = c.offset()
            c.offset()
            self.end = c.offset()
            c.offset()
            c.offset()  # name of the root entry
            self.root = c.offset()
        elif self.version in (2, 3):
            self.offsets, self.lengths = c.num(1), c.num(1)
            c.take(1)
            c.offsets, c.lengths = self.offsets, self.lengths
            self.base = c.offset()
            c.offset()
            self.end = c.offset()
            self.root = c.offset()
            if lookup3(c.data[: c.at]) != c.num(4):
                raise FormatError("checksum of the superblock differs")
        else:
            raise UnsupportedError(f"superblock version {self.version}")
        if self.offsets not in (2, 4, 8) or self.lengths not in (2, 4, 8):
            raise FormatError("odd sizes of offsets or lengths")

    # blocks

    def cursor(self, at: int, n: int) -> Cursor:
        if at == UNDEFINED:
            raise FormatError("an address is undefined")
        return Cursor(self.bytes.read(self.base + at, n), self.offsets, self.lengths)

    def checked(self, at: int, n: int, sign: bytes) -> Cursor:
        """A block of ``n`` bytes that ends with its checksum."""
        c = self.cursor(at, n)
        if lookup3(c.data[:-4]) != int.from_bytes(c.data[-4:], "little"):
            raise FormatError(f"checksum of a {sign.decode()} block differs")
        c.sign(sign)
        return c

    def header(self, at: int) -> Header:
        probe = self.cursor(at, min(16, self.bytes.size - self.base - at))
        return self._header2(at) if probe.data[:4] == b"OHDR" else self._header1(at)

    def _header1(self, at: int) -> Header:
        c = self.cursor(at, 16)
        if c.num(1) != 1:
            raise UnsupportedError("object header version")
        c.take(1)
        count = c.num(2)
        c.take(4)
        blocks, out = [(at + 16, c.num(4))], []
        while blocks and len(out) < count:
            start, size = blocks.pop(0)
            b = self.cursor(start, size)
            while b.left >= 8 and len(out) < count:
                kind, n, flags = b.num(2), b.num(2), b.num(1)
                b.take(3)
                body = b.take(n)
                out.append((kind, body, flags))
                if kind == CONTINUATION:
                    k = Cursor(body, self.offsets, self.lengths)
                    blocks.append((k.offset(), k.length()))
                    if len(blocks) + len(out) > 100_000:
                        raise FormatError("an object header does not end")
        return Header(at, out)

    def _header2(self, at: int) -> Header:
        c = self.cursor(at, min(48, self.bytes.size - self.base - at))
        c.sign(b"OHDR")
        if c.num(1) != 2:
            raise UnsupportedError("object header version")
        flags = c.num(1)
        times = tuple(c.num(4) for _ in range(4)) if flags & 0x20 else ()
        if flags & 0x10:
            c.take(4)
        size = c.num(1 << (flags & 3))
        head = c.at
        todo, out, seen = [(at, head, head + size + 4, b"OHDR")], [], set()
        while todo:
            start, skip, n, sign = todo.pop(0)
            if start in seen:
                raise FormatError("an object header runs in a circle")
            seen.add(start)
            b = self.checked(start, n, sign)
            b.at = skip
            while len(b.data) - 4 - b.at >= 4 + (2 if flags & 4 else 0):
                kind, n, mf = b.num(1), b.num(2), b.num(1)
                if flags & 4:
                    b.take(2)
                body = b.take(n)
                if kind == CONTINUATION:
                    k = Cursor(body, self.offsets, self.lengths)
                    where, length = k.offset(), k.length()
                    todo.append((where, 4, length, b"OCHK"))
                elif kind:
                    out.append((kind, body, mf))
        return Header(at, out, times)

    def _c(self, body: bytes) -> Cursor:
        return Cursor(body, self.offsets, self.lengths)

    def type_of(self, body: bytes, flags: int = 0) -> Type:
        """A datatype, or the committed one that a shared message points to."""
        if flags & 2:
            c = self._c(body)
            version, kind = c.num(1), c.num(1)
            if version == 1:
                c.take(6)
            if version == 3 and kind == 1:
                raise UnsupportedError("a datatype in the shared message heap")
            return self.type_of(*self._typed(self.header(c.offset())))
        return read_type(self._c(body))

    @staticmethod
    def _typed(h: Header) -> tuple[bytes, int]:
        return next((b, f) for k, b, f in h.messages if k == DATATYPE)

    # groups

    def links(self, at: int) -> list[Link]:
        h = self.header(at)
        out = [self._link(b) for k, b, _ in h.messages if k == LINK]
        if table := h.first(SYMBOLS):
            c = self._c(table)
            out += self._symbols(c.offset(), c.offset())
        if info := h.first(LINK_INFO):
            c = self._c(info)
            c.take(1)
            flags = c.num(1)
            if flags & 1:
                c.take(8)
            heap, names = c.offset(), c.offset()
            if heap != UNDEFINED:
                fh = Heap(self, heap)
                out += [self._link(fh.get(r[4:])) for r in self.tree2(names)]
        return out

    def _link(self, body: bytes) -> Link:
        c = self._c(body)
        if c.num(1) != 1:
            raise UnsupportedError("link message version")
        flags = c.num(1)
        kind = c.num(1) if flags & 8 else 0
        order = c.num(8) if flags & 4 else 0
        if flags & 16:
            c.take(1)
        name = c.take(c.num(1 << (flags & 3))).decode()
        if kind == 0:
            return Link(name, "hard", c.offset(), order)
        raw = c.take(c.num(2))
        if kind == 1:
            return Link(name, "soft", raw.decode(), order)
        if kind == 64:
            file, target = raw[1:].split(b"\0")[:2]
            return Link(name, "external", (file.decode(), target.decode()), order)
        return Link(name, "user", raw, order)

    def _symbols(self, tree: int, heap: int) -> list[Link]:
        c = self.cursor(heap, 8 + 2 * self.lengths + self.offsets)
        c.sign(b"HEAP")
        c.take(4)
        size = c.length()
        c.length()
        names = self.cursor(c.offset(), size).data
        out = []
        for node in self.tree1(tree, 0, lambda k: k.length()):
            s = self.cursor(node[1], 8)
            s.sign(b"SNOD")
            s.take(2)
            n = s.num(2)
            e = self.cursor(node[1] + 8, n * (2 * self.offsets + 24))
            for _ in range(n):
                name, target, cache = e.offset(), e.offset(), e.num(4)
                e.take(4)
                scratch = e.take(16)
                text = names[name : names.index(b"\0", name)].decode()
                if cache == 2:
                    v = int.from_bytes(scratch[:4], "little")
                    out.append(Link(text, "soft", names[v : names.index(b"\0", v)].decode(), len(out)))
                else:
                    out.append(Link(text, "hard", target, len(out)))
        return out

    def tree1(self, at: int, kind: int, key: Callable[[Cursor], object], depth: int = 0) -> Iterator[tuple[object, int]]:
        """(key, child) of the leaves of a version 1 tree."""
        if depth > MAX_DEPTH:
            raise FormatError("a tree is too deep")
        c = self.cursor(at, 8 + 2 * self.offsets)
        c.sign(b"TREE")
        if c.num(1) != kind:
            raise FormatError("a tree of another kind")
        level, n = c.num(1), c.num(2)
        room = n * 2 * 300 + 300
        body = self.cursor(at + 8 + 2 * self.offsets, min(room, self.bytes.size - self.base - at - 8 - 2 * self.offsets))
        for _ in range(n):
            k = key(body)
            child = body.offset()
            if level:
                yield from self.tree1(child, kind, key, depth + 1)
            else:
                yield k, child

    def tree2(self, at: int) -> Iterator[bytes]:
        """The records of a version 2 tree, in order."""
        c = self.checked(at, 16 + self.offsets + 2 + self.lengths + 4, b"BTHD")
        c.take(2)
        node, record, depth = c.num(4), c.num(2), c.num(2)
        c.take(2)
        root, n = c.offset(), c.num(2)
        if root == UNDEFINED or not n:
            return
        most = [(node - 10) // record]  # records of a node at each level, and below it in all
        total = [most[0]]
        width = lambda v: (v.bit_length() + 7) // 8
        for d in range(1, depth + 1):
            pointer = self.offsets + width(most[d - 1]) + (width(total[d - 1]) if d > 1 else 0)
            most.append((node - 10 - pointer) // (record + pointer))
            total.append((most[d] + 1) * total[d - 1] + most[d])

        def walk(at: int, n: int, d: int) -> Iterator[bytes]:
            if d == 0:
                b = self.checked(at, 6 + n * record + 4, b"BTLF")
                b.take(2)
                for _ in range(n):
                    yield b.take(record)
                return
            a, t = width(most[d - 1]), width(total[d - 1]) if d > 1 else 0
            b = self.checked(at, 6 + n * record + (n + 1) * (self.offsets + a + t) + 4, b"BTIN")
            b.take(2)
            records = [b.take(record) for _ in range(n)]
            for i in range(n + 1):
                child, k = b.offset(), b.num(a)
                b.take(t)
                yield from walk(child, k, d - 1)
                if i < n:
                    yield records[i]

        yield from walk(root, n, depth)

    def resolve(self, path: str) -> tuple[Container, int]:
        """(container, address) of the object at a path; soft and external links are followed, at most 40."""
        space, at, hops = self, self.root, 0
        todo = [p for p in canonical(path).split("/") if p]
        here: list[str] = []
        while todo:
            part = todo.pop(0)
            link = next((x for x in space.links(at) if x.name == part), None)
            if link is None:
                raise FormatError(f"no link {part!r}")
            if link.kind == "hard":
                at, here = link.target, [*here, part]
                continue
            hops += 1
            if hops > MAX_HOPS:
                raise FormatError("links lead in a circle")
            if link.kind == "soft":
                target = link.target if link.target.startswith("/") else "/".join(["", *here, link.target])
            elif link.kind == "external":
                file, target = link.target
                space = space._open(file if file.startswith("/") else f"{space.path.rsplit('/', 1)[0]}/{file}")
            else:
                raise UnsupportedError("a user-defined link")
            todo = [p for p in canonical(target).split("/") if p] + todo
            at, here = space.root, []
        return space, at

    def info(self) -> dict:
        """What the superblock and the tree say about the file."""
        kinds = [k for _, _, k, _ in self.walk()]
        return {
            "path": self.path, "bytes": self.bytes.size, "userblock": self.userblock, "version": self.version, "end": self.end, "free": max(0, self.bytes.size - self.end),
            "offset_size": self.offsets, "length_size": self.lengths, "groups": 1 + kinds.count("group"), "datasets": kinds.count("dataset"), "datatypes": kinds.count("datatype"),
        }

    def kind(self, at: int) -> str:
        kinds = {k for k, _, _ in self.header(at).messages}
        if DATASPACE in kinds and DATATYPE in kinds:
            return "dataset"
        return "datatype" if DATATYPE in kinds else "group"

    def walk(self) -> Iterator[tuple[str, str, str, object]]:
        """(path, link kind, object kind, target) of everything below the root; objects met before are not entered again."""
        todo, seen = [("", self.root)], {self.root}
        while todo:
            path, at = todo.pop(0)
            for x in self.links(at):
                kind = self.kind(x.target) if x.kind == "hard" else ""
                yield f"{path}/{x.name}", x.kind, kind, x.target
                if kind == "group" and x.target not in seen:
                    seen.add(x.target)
                    todo.append((f"{path}/{x.name}", x.target))

    def attributes(self, path: str) -> dict[str, object]:
        space, at = self.resolve(path)
        return space._attributes(at)

    def attribute(self, path: str, name: str, kind: str | None = None) -> object:
        """One attribute, a scalar or a list, as ``kind`` (see :func:`tesserae.functions.convert.plain_as`)."""
        found = self.attributes(path)
        if name not in found:
            raise FormatError(f"no attribute {name!r}")
        return plain_as(found[name], kind)

    def _attributes(self, at: int) -> dict[str, object]:
        h = self.header(at)
        out = dict(self._attribute(b) for k, b, _ in h.messages if k == ATTRIBUTE)
        if info := h.first(ATTRIBUTE_INFO):
            c = self._c(info)
            c.take(1)
            flags = c.num(1)
            if flags & 1:
                c.take(2)
            heap, names = c.offset(), c.offset()
            if heap != UNDEFINED:
                fh = Heap(self, heap)
                out |= dict(self._attribute(fh.get(r[:8])) for r in self.tree2(names))
        return out

    def _attribute(self, body: bytes) -> tuple[str, object]:
        c = self._c(body)
        version, flags = c.num(1), c.num(1)
        sizes = [c.num(2) for _ in range(3)]
        if version == 3:
            c.take(1)
        parts = []
        for n in sizes:
            parts.append(c.take(n))
            if version == 1:
                c.take(-n % 8)
        name = parts[0].split(b"\0")[0].decode()
        t = self.type_of(parts[1], 2 if version > 1 and flags & 1 else 0)
        shape = read_shape(self._c(parts[2]))
        values = decode(c.take(shape.size * t.size), t, shape.size, self)
        return name, values[0] if shape.dims == () else values

    def dataset(self, path: str) -> Dataset:
        space, at = self.resolve(path)
        if space.kind(at) != "dataset":
            raise FormatError(f"{path} is no dataset")
        return Dataset(space, at)

    def heap_object(self, at: int, index: int) -> bytes:
        """An object of a global heap collection."""
        c = self.cursor(at, 8 + self.lengths)
        c.sign(b"GCOL")
        c.take(4)
        size = c.length()
        c = self.cursor(at, size)
        c.at = 8 + self.lengths
        while c.left >= 8 + self.lengths:
            i = c.num(2)
            c.take(6)
            n = c.length()
            if i == 0:
                break
            body = c.take(n)
            c.take(min(-n % 8, c.left))
            if i == index:
                return body
        raise FormatError("no such object in a global heap")


class Heap:
    """A fractal heap: objects by id."""

    def __init__(self, file: Container, at: int):
        o, n = file.offsets, file.lengths
        size = 4 + 1 + 2 + 2 + 1 + 4 + n + o + n + o + 8 * n + 2 + 2 * n + 2 + 2 + o + 2 + 4
        c = file.cursor(at, size)
        c.sign(b"FRHP")
        c.take(1)
        self.file, self.id_size = file, c.num(2)
        filters = c.num(2)
        if filters:
            raise UnsupportedError("a filtered fractal heap")
        self.flags = c.num(1)
        self.most = c.num(4)
        c.take(n)
        self.huge = c.offset()
        c.take(n)
        c.offset()
        c.take(8 * n)
        self.width = c.num(2)
        self.first, self.direct = c.length(), c.length()
        self.bits = c.num(2)
        c.take(2)
        self.root, self.rows = c.offset(), c.num(2)
        if lookup3(c.data[: c.at]) != c.num(4):
            raise FormatError("checksum of a FRHP block differs")
        self.offset_size = (self.bits + 7) // 8
        self.length_size = (min(self.direct, self.most).bit_length() + 7) // 8

    def row_size(self, r: int) -> int:
        return self.first << max(0, r - 1)

    def get(self, key: bytes) -> bytes:
        kind = key[0] >> 4 & 3
        if kind == 2:  # tiny: the object is in the id
            n = (key[0] & 15) + 1 if self.id_size <= 17 else ((key[0] & 15) << 8 | key[1]) + 1
            return key[1 if self.id_size <= 17 else 2 :][:n]
        if kind != 0:
            raise UnsupportedError("huge objects of a fractal heap")
        at = int.from_bytes(key[1 : 1 + self.offset_size], "little")
        n = int.from_bytes(key[1 + self.offset_size :][: self.length_size], "little")
        block, start = self._find(at)
        return self.file.bytes.read(self.file.base + block + at - start, n)

    def _find(self, at: int) -> tuple[int, int]:
        """(address, heap offset) of the direct block that holds an offset."""
        if not self.rows:
            return self.root, 0
        block, start, rows = self.root, 0, self.rows
        direct_rows = (self.direct // self.first).bit_length() + 1
        for _ in range(MAX_DEPTH):
            n_direct = min(rows, direct_rows) * self.width
            n_indirect = max(0, rows - direct_rows) * self.width
            c = self.file.checked(block, 5 + self.file.offsets + self.offset_size + (n_direct + n_indirect) * self.file.offsets + 4, b"FHIB")
            c.take(1 + self.file.offsets + self.offset_size)
            where = start
            for r in range(rows):
                size = self.row_size(r)
                if at < where + size * self.width:
                    k = (at - where) // size
                    c.take((r * self.width + k) * self.file.offsets)
                    block, start = c.offset(), where + k * size
                    if r < direct_rows:
                        return block, start
                    # rows of an indirect block that spans `size`
                    rows = (size // (self.first * self.width)).bit_length()
                    break
                where += size * self.width
            else:
                raise FormatError("an offset is outside its fractal heap")
        raise FormatError("a fractal heap is too deep")


def decode(data: bytes, t: Type, n: int, file: Container | None) -> list:
    """``n`` stored elements as Python values."""
    if len(data) < n * t.size:
        raise FormatError("element bytes end too soon")
    if t.kind in ("int", "time", "bits", "enum", "float", "reference") and t.dtype.kind in "iuf":
        return np.frombuffer(data, t.dtype, n).tolist()
    cut = [data[i * t.size : (i + 1) * t.size] for i in range(n)]
    if t.kind == "string":
        texts = [b.split(b"\0")[0].decode() for b in cut]
        return [s.rstrip() for s in texts] if t.padding == 2 else texts
    if t.kind in ("vstring", "sequence"):
        out = []
        for b in cut:
            c = Cursor(b, file.offsets, file.lengths)
            count, at, index = c.num(4), c.offset(), c.num(4)
            raw = file.heap_object(at, index) if count and at not in (0, UNDEFINED) else b""
            if t.kind == "vstring":
                out.append(raw[:count].rstrip(b"\0").decode())
            else:
                out.append(decode(raw, t.base, count if raw else 0, file))
        return out
    if t.kind == "array":
        return [decode(b, t.base, prod(t.dims), file) for b in cut]
    if t.kind == "compound":
        cols = [decode(b"".join(b[p : p + m.size] for b in cut), m, n, file) for _, p, m in t.members]
        return [dict(zip((m[0] for m in t.members), row)) for row in zip(*cols)] if cols else [{} for _ in cut]
    return cut


def read_selection(c: Cursor, shape: Shape) -> Selection | list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """A stored selection; an irregular one is a list of blocks (inclusive corners)."""
    kind, version = c.num(4), c.num(4)
    if kind in (0, 3):
        c.take(8)
        return Nothing() if kind == 0 else Everything()
    if kind == 1:
        if version == 1:
            c.take(8)
            size = 4
            rank, n = c.num(4), c.num(4)
        elif version == 2:
            size = c.num(1)
            rank, n = c.num(4), c.num(size)
        else:
            raise UnsupportedError(f"point selection version {version}")
        return Points([[c.num(size) for _ in range(rank)] for _ in range(n)])
    if kind != 2:
        raise FormatError(f"selection kind {kind}")
    flags, size = 0, 4
    if version == 1:
        c.take(8)
    elif version == 2:
        flags, size = c.num(1), 8
        c.take(4)
    elif version == 3:
        flags, size = c.num(1), c.num(1)
    else:
        raise UnsupportedError(f"block selection version {version}")
    rank = c.num(4)
    if flags & 1:
        endless = (1 << 8 * size) - 1
        spans = []
        for _ in range(rank):
            start, stride, count, block = (c.num(size) for _ in range(4))
            if block == endless:
                start, stride, count, block = start, 1, None, 1
            spans.append(Span(start, max(stride, 1), None if count in (endless, None) else count, block))
        return Hyperslab(*spans)
    n = c.num(size)
    return [(tuple(c.num(size) for _ in range(rank)), tuple(c.num(size) for _ in range(rank))) for _ in range(n)]


@dataclass
class Dataset:
    """A dataset's metadata; its elements come from :meth:`pieces`."""

    file: Container
    at: int
    _header: Header = field(init=False)

    def __post_init__(self):
        self._header = self.file.header(self.at)

    @cached_property
    def type(self) -> Type:
        return self.file.type_of(*Container._typed(self._header))

    @cached_property
    def shape(self) -> Shape:
        return read_shape(self.file._c(self._header.first(DATASPACE)))

    @cached_property
    def filters(self) -> list[tuple[str, list[int]]]:
        body = self._header.first(FILTERS)
        return read_filters(self.file._c(body)) if body else []

    @cached_property
    def fill(self) -> bytes:
        """One element for what is not stored: zeros unless a value is defined."""
        for kind in (FILL, OLD_FILL):
            if body := self._header.first(kind):
                c = self.file._c(body)
                if kind == OLD_FILL:
                    defined, late = True, 0
                else:
                    version = c.num(1)
                    if version == 3:
                        flags = c.num(1)
                        defined, late = bool(flags & 0x20), flags >> 2 & 3
                    else:
                        c.take(1)
                        late = c.num(1)
                        defined = bool(c.num(1)) or version == 1
                n = c.num(4) if defined else 0
                if n and late != 1:
                    if n != self.type.size:
                        raise UnsupportedError("a fill value of another size")
                    return c.take(n)
        return bytes(self.type.size)

    @cached_property
    def layout(self) -> dict:
        c = self.file._c(self._header.first(LAYOUT) or b"")
        version = c.num(1)
        if version in (1, 2):
            rank, kind = c.num(1), c.num(1)
            c.take(5)
            at = c.offset() if kind else UNDEFINED
            dims = [c.num(4) for _ in range(rank)]
            if kind == 0:
                return {"kind": "compact", "data": c.take(c.num(4))}
            if kind == 1:
                return {"kind": "contiguous", "at": at, "size": prod(dims)}
            return {"kind": "chunked", "index": "b-tree v1", "at": at, "chunk": tuple(dims[: self.shape.rank])}
        kind = c.num(1)
        if kind == 0:
            return {"kind": "compact", "data": c.take(c.num(2))}
        if kind == 1:
            return {"kind": "contiguous", "at": c.offset(), "size": c.length()}
        if kind == 3:
            return {"kind": "virtual", "at": c.offset(), "index": c.num(4)}
        if kind != 2 or version not in (3, 4):
            raise UnsupportedError(f"layout version {version}, class {kind}")
        if version == 3:
            rank = c.num(1)
            at = c.offset()
            return {"kind": "chunked", "index": "b-tree v1", "at": at, "chunk": tuple(c.num(4) for _ in range(rank))[:-1]}
        flags, rank, enc = c.num(1), c.num(1), c.num(1)
        out = {"kind": "chunked", "chunk": tuple(c.num(enc) for _ in range(rank))[:-1], "whole_edges": not flags & 1}
        kind = c.num(1)
        out["index"] = {1: "single chunk", 2: "implicit", 3: "fixed array", 4: "extensible array", 5: "b-tree v2"}.get(kind, "")
        if kind == 1 and flags & 2:
            out["size"], out["mask"] = c.length(), c.num(4)
        elif kind in (3, 4, 5):
            c.take({3: 1, 4: 5, 5: 6}[kind])
        out["at"] = c.offset()
        return out

    @property
    def chunk_bytes(self) -> int:
        return prod(self.layout["chunk"]) * self.type.size

    def pieces(self) -> list[Piece]:
        """What is stored.  Compact data have none: they are in the header."""
        at, zero = self.layout, (0,) * self.shape.rank
        if at["kind"] == "compact" or not self.shape.size:
            return []
        if at["kind"] == "contiguous":
            if self._header.first(EXTERNAL):
                raise UnsupportedError("raw data in other files are read with external_pieces()")
            return [] if at["at"] == UNDEFINED else [Piece(at["at"], self.shape.size * self.type.size, 0, zero)]
        if at["kind"] == "virtual":
            raise UnsupportedError("virtual layouts are built with tesserae.operators.virtual")
        if at["at"] == UNDEFINED:
            return []
        return sorted(getattr(self, "_" + at["index"].replace(" ", "_").replace("-", "_"))(), key=lambda p: p.start)

    def external_pieces(self) -> list[tuple[str, int, int]]:
        """(file, offset, size) of raw data kept outside, in order."""
        body = self._header.first(EXTERNAL)
        if not body:
            return []
        c = self.file._c(body)
        c.take(4 + 2)
        n = c.num(2)
        heap = self.file.cursor(c.offset(), 8 + 2 * self.file.lengths + self.file.offsets)
        heap.sign(b"HEAP")
        heap.take(4)
        size = heap.length()
        heap.length()
        names = self.file.cursor(heap.offset(), size).data
        out = []
        for _ in range(n):
            name, at, size = c.length(), c.length(), c.length()
            out.append((names[name : names.index(b"\0", name)].decode(), at, size))
        return out

    def describe(self) -> dict:
        """Shape, type, storage, filters, fill value and allocation."""
        kind = self.layout["kind"]
        pieces = self.pieces() if kind in ("chunked", "contiguous") and not self.external_pieces() else []
        expected = prod(self._grid()) if kind == "chunked" else 1
        status = "allocated" if kind in ("compact", "virtual") or self.external_pieces() or len(pieces) >= expected else "part allocated" if pieces else "not allocated"
        return {
            "dims": self.shape.dims, "max_dims": self.shape.max_dims, "type": self.type.spark(), "element_size": self.type.size, "layout": kind, "index": self.layout.get("index"),
            "chunk": self.layout.get("chunk"), "filters": [n for n, _ in self.filters], "fill": self.fill_value(), "chunks": len(pieces), "expected": expected, "stored_bytes": sum(p.size for p in pieces), "status": status,
        }

    def external_bytes(self, first: int = 0, last: int | None = None) -> bytes:
        """Bytes first..last of the raw data kept outside, joined in order; too few bytes are an error."""
        folder = self.file.path.rsplit("/", 1)[0] if "/" in self.file.path else "."
        last = self.shape.size * self.type.size if last is None else last
        want, out, begin = last - first, [], 0
        for name, at, size in self.external_pieces():
            lo, hi = max(first, begin), min(last, begin + size)
            if lo < hi:
                out.append(Bytes(name if name.startswith("/") or "://" in name else f"{folder}/{name}").read(at + lo - begin, hi - lo))
            begin += size
        if begin < last:
            raise FormatError(f"{min(begin, last) - first} bytes in other files, {want} expected")
        return b"".join(out)

    def mappings(self) -> list[tuple[str, str, object, object]]:
        """(file, dataset, source selection, own selection) of a virtual dataset, in order."""
        if self.layout["kind"] != "virtual":
            raise FormatError("not a virtual dataset")
        body = self.file.heap_object(self.layout["at"], self.layout["index"])
        if lookup3(body[:-4]) != int.from_bytes(body[-4:], "little"):
            raise FormatError("checksum of a mapping list differs")
        c = self.file._c(body[:-4])
        if c.num(1) != 0:
            raise UnsupportedError("mapping list version")
        return [(c.text(), c.text(), read_selection(c, self.shape), read_selection(c, self.shape)) for _ in range(c.length())]

    # chunk indexes

    def _grid(self) -> tuple[int, ...]:
        return tuple(-(-d // c) for d, c in zip(self.shape.dims, self.layout["chunk"]))

    def _place(self, k: int, grid: tuple[int, ...]) -> tuple[int, ...]:
        out = []
        for g, c in zip(reversed(grid), reversed(self.layout["chunk"])):
            out.insert(0, k % g * c)
            k //= g
        return tuple(out)

    @property
    def _size_bytes(self) -> int:
        """Bytes that hold a filtered chunk's size."""
        return min(8, 1 + (self.chunk_bytes.bit_length() - 1 + 8) // 8)

    def _element(self, c: Cursor) -> tuple[int, int, int]:
        at = c.offset()
        return (at, c.num(self._size_bytes), c.num(4)) if self.filters else (at, self.chunk_bytes, 0)

    @property
    def _element_size(self) -> int:
        return self.file.offsets + (self._size_bytes + 4 if self.filters else 0)

    def _listed(self, elements: Iterator[tuple[int, tuple[int, int, int]]], grid: tuple[int, ...]) -> Iterator[Piece]:
        n = prod(grid)
        for k, (at, size, mask) in elements:
            if k < n and at != UNDEFINED:
                yield Piece(at, size, mask, self._place(k, grid))

    def _b_tree_v1(self):
        def key(c: Cursor):
            size, mask = c.num(4), c.num(4)
            start = tuple(c.num(8) for _ in range(self.shape.rank))
            c.num(8)
            return size, mask, start

        for (size, mask, start), at in self.file.tree1(self.layout["at"], 1, key):
            if all(s < d for s, d in zip(start, self.shape.dims)):
                yield Piece(at, size, mask, start)

    def _single_chunk(self):
        yield Piece(self.layout["at"], self.layout.get("size", self.chunk_bytes), self.layout.get("mask", 0), (0,) * self.shape.rank)

    def _implicit(self):
        grid = self._grid()
        for k in range(prod(grid)):
            yield Piece(self.layout["at"] + k * self.chunk_bytes, self.chunk_bytes, 0, self._place(k, grid))

    def _fixed_array(self):
        f = self.file
        c = f.checked(self.layout["at"], 8 + f.lengths + f.offsets + 4, b"FAHD")
        c.take(3)
        page, count, block = 1 << c.num(1), c.length(), c.offset()
        if block == UNDEFINED:
            return
        e = self._element_size
        head = 6 + f.offsets
        if count <= page:
            b = f.checked(block, head + count * e + 4, b"FADB")
            b.at = head
            yield from self._listed(((k, self._element(b)) for k in range(count)), self._grid())
            return
        pages = -(-count // page)
        b = f.checked(block, head + (pages + 7) // 8 + 4, b"FADB")
        b.at = head
        made = b.take((pages + 7) // 8)
        at = block + len(b.data)
        for p in range(pages):
            n = min(page, count - p * page)
            if made[p // 8] & 0x80 >> p % 8:
                yield from self._listed(self._page(at, n, p * page), self._grid())
            at += page * e + 4

    def _page(self, at: int, n: int, first: int) -> Iterator[tuple[int, tuple[int, int, int]]]:
        c = self.file.cursor(at, n * self._element_size + 4)
        if lookup3(c.data[:-4]) != int.from_bytes(c.data[-4:], "little"):
            raise FormatError("checksum of a page differs")
        for k in range(n):
            yield first + k, self._element(c)

    def _extensible_array(self):
        f, e = self.file, self._element_size
        c = f.checked(self.layout["at"], 12 + 6 * f.lengths + f.offsets + 4, b"EAHD")
        c.take(3)
        bits, in_index, least, pointers, page_bits = (c.num(1) for _ in range(5))
        c.take(6 * f.lengths)
        index = c.offset()
        if index == UNDEFINED:
            return
        # chunk numbers count along the unlimited axis last: the growing axis moves slowest
        grid = self._grid()
        grow = next((i for i, m in enumerate(self.shape.largest) if m is None), 0)
        order = (grow, *(i for i in range(len(grid)) if i != grow))
        n_super = 1 + bits - (least.bit_length() - 1)
        direct_super = 2 * (pointers.bit_length() - 1)
        supers = [(1 << k // 2, least << (k + 1) // 2) for k in range(n_super)]  # data blocks, elements of each
        n_direct = sum(n for n, _ in supers[:direct_super])
        b = f.checked(index, 6 + f.offsets + in_index * e + (n_direct + n_super - direct_super) * f.offsets + 4, b"EAIB")
        b.at = 6 + f.offsets
        offset_size = (bits + 7) // 8
        page = 1 << page_bits

        def block(at: int, n: int, first: int, made: bytes | None) -> Iterator[tuple[int, tuple[int, int, int]]]:
            head = 6 + f.offsets + offset_size
            if n <= page:
                d = f.checked(at, head + n * e + 4, b"EADB")
                d.at = head
                for k in range(n):
                    yield first + k, self._element(d)
                return
            f.checked(at, head + 4, b"EADB")
            for p in range(n // page):
                if made is None or made[p // 8] & 0x80 >> p % 8:
                    yield from self._page(at + head + 4 + p * (page * e + 4), page, first + p * page)

        def elements() -> Iterator[tuple[int, tuple[int, int, int]]]:
            for k in range(in_index):
                yield k, self._element(b)
            first = in_index
            total = prod(grid)
            for n, size in supers[:direct_super]:
                for _ in range(n):
                    at = b.offset()
                    if at != UNDEFINED and first < total:
                        yield from block(at, size, first, None)
                    first += size
            for n, size in supers[direct_super:]:
                at = b.offset()
                if at != UNDEFINED and first < total:
                    maps = (size // page + 7) // 8 if size > page else 0
                    s = f.checked(at, 6 + f.offsets + offset_size + n * maps + n * f.offsets + 4, b"EASB")
                    s.at = 6 + f.offsets + offset_size
                    made = [s.take(maps) for _ in range(n)]
                    for i in range(n):
                        d = s.offset()
                        if d != UNDEFINED:
                            yield from block(d, size, first + i * size, made[i] if maps else None)
                first += n * size

        moved = tuple(grid[i] for i in order)
        for k, (at, size, mask) in elements():
            if k < prod(grid) and at != UNDEFINED:
                place, left = [0] * len(grid), k
                for i, g in zip(reversed(order), reversed(moved)):
                    place[i] = left % g * self.layout["chunk"][i]
                    left //= g
                yield Piece(at, size, mask, tuple(place))

    def _b_tree_v2(self):
        for r in self.file.tree2(self.layout["at"]):
            c = self.file._c(r)
            at, size, mask = self._element(c)
            yield Piece(at, size, mask, tuple(c.num(8) * n for n in self.layout["chunk"]))

    # elements

    def pipeline(self) -> Pipeline:
        out = []
        for name, v in self.filters:
            options: dict = {}
            if name == "shuffle":
                options = {"size": v[0] if v else self.type.size}
            elif name == "lzf":
                options = {"bytes": v[2] if len(v) > 2 and v[2] else self.chunk_bytes}
            elif name == "nbit":
                t = self.type
                options = {"members": [Bits(t.size, t.precision or 8 * t.size, t.bit_offset, t.big)], "n": prod(self.layout["chunk"])}
            elif name == "scaleoffset":
                options = {"values": v, "type": self.type}
            out.append(Filter(name, options))
        return Pipeline(tuple(out))

    def stored(self, piece: Piece) -> bytes:
        """The decoded bytes of a piece."""
        raw = self.file.bytes.read(self.file.base + piece.at, piece.size)
        if not self.filters or self.layout["kind"] != "chunked":
            return raw
        return self.pipeline().decode(raw, self.chunk_bytes, piece.mask)

    def linear(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray | list]:
        """Coordinates and values of the elements first..last in row-major order, of a layout without chunks: only their bytes are read."""
        size, n = self.type.size, last - first
        if self.layout["kind"] == "compact":
            data = self.layout["data"][first * size : last * size]
        elif self.external_pieces():
            data = self.external_bytes(first * size, last * size)
        elif self.layout["at"] == UNDEFINED:
            data = self.fill * n
        else:
            data = self.file.bytes.read(self.file.base + self.layout["at"] + first * size, n * size)
        at = np.arange(first, last)
        coords = np.stack(np.unravel_index(at, self.shape.dims), 1) if self.shape.dims else np.zeros((n, 0), np.int64)
        return coords, self.values(data, n)

    def values(self, data: bytes, n: int) -> np.ndarray | list:
        """Numbers as an array in the machine's byte order, anything else as Python values."""
        kind = self.type.dtype
        if self.type.kind in ("int", "float", "time", "bits", "enum") and kind.kind in "iuf" and kind != np.dtype("<u8") and kind != np.dtype(">u8"):
            if len(data) < n * self.type.size:
                raise FormatError("element bytes end too soon")
            return np.frombuffer(data, kind, n).astype(kind.newbyteorder("="))
        return decode(data, self.type, n, self.file)

    def elements(self, piece: Piece) -> tuple[np.ndarray, np.ndarray | list]:
        """Coordinates (one row each) and values of a piece, inside the shape."""
        dims = self.shape.dims
        chunk = self.layout["chunk"] if self.layout["kind"] == "chunked" else dims
        data = self.stored(piece)
        keep = [min(c, d - s) for c, d, s in zip(chunk, dims, piece.start)]
        if len(keep) == 1:
            return np.arange(piece.start[0], piece.start[0] + keep[0])[:, None], self.values(data[: keep[0] * self.type.size], keep[0])
        cells = np.frombuffer(data, np.dtype(f"V{self.type.size}"), prod(chunk)).reshape(chunk)[tuple(slice(0, k) for k in keep)]
        coords = np.indices(keep, np.int64).reshape(len(keep), prod(keep)).T + np.array(piece.start, np.int64)
        return coords, self.values(cells.tobytes(), prod(keep))

    def fill_value(self):
        return decode(self.fill, self.type, 1, self.file)[0] if self.type.kind not in ("vstring", "sequence") else ("" if self.type.kind == "vstring" else [])

    def numpy_order(self) -> list:
        """All elements, row-major, at the driver: for small datasets."""
        n = self.shape.size
        if self.layout["kind"] == "compact":
            return decode(self.layout["data"], self.type, n, self.file)
        if self.external_pieces():
            return decode(self.external_bytes(), self.type, n, self.file)
        out = [self.fill_value()] * n
        steps = self.shape.strides
        for p in self.pieces():
            coords, values = self.elements(p)
            for at, v in zip((coords * np.array(steps, np.int64)).sum(1).tolist(), values.tolist() if isinstance(values, np.ndarray) else values):
                out[at] = v
        return out


def unpack_scale_offset(data: bytes, options: dict) -> bytes:
    """The scale-offset codec of chunks: a header with the bits and the smallest value, then packed numbers."""
    v, t = options["values"], options["type"]
    kind, scale, n, size = v[0], v[1], v[2], v[4]
    has_fill = bool(v[7]) if len(v) > 7 else False
    bits = int.from_bytes(data[:4], "little")
    low = int.from_bytes(data[5 : 5 + min(8, data[4])], "little", signed=True)
    fill = b"".join(x.to_bytes(4, "little") for x in v[8:])[:size] if has_fill else b""
    if bits == 8 * size:
        return data[21 : 21 + n * size]
    k = unpack_bits(data[21:], bits, n)
    ones = (1 << bits) - 1
    if kind == 2:
        out = (k.astype(np.int64) + np.int64(low)).astype(f"<i{size}")
    elif kind == 0:
        base = np.frombuffer(data[5 : 5 + size], f"<f{size}")[0]
        out = (k.astype(np.float64) / 10.0**scale + base).astype(f"<f{size}")
    else:
        raise UnsupportedError("this scale type")
    if has_fill and bits:
        out = np.where(k == ones, np.frombuffer(fill, out.dtype)[0], out)
    return out.astype(t.dtype).tobytes() if t.dtype.kind in "iuf" else out.tobytes()


REGISTRY.register("scaleoffset", None, unpack_scale_offset)
