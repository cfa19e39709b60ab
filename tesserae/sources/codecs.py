"""Chunk codecs and the filter pipeline, as byte functions and as Arrow operators over chunk rows.

A pipeline lists filters in writing order; reading applies them from last to first and skips those
whose bit is set in the chunk's mask.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import FormatError, UnsupportedError

MAX_FILTERS = 32


def shuffle(data: bytes, size: int) -> bytes:
    """Byte planes of elements of ``size`` bytes; a tail shorter than an element stays at the end."""
    n = len(data) // size if size else 0
    if size <= 1 or n <= 1:
        return data
    body = np.frombuffer(data, np.uint8, n * size).reshape(n, size)
    return body.T.tobytes() + data[n * size :]


def unshuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size if size else 0
    if size <= 1 or n <= 1:
        return data
    body = np.frombuffer(data, np.uint8, n * size).reshape(size, n)
    return body.T.tobytes() + data[n * size :]


def deflate(data: bytes, level: int = 6) -> bytes:
    return zlib.compress(data, level)


def inflate(data: bytes, size: int | None = None) -> bytes:
    """Inflated bytes; bytes after the stream, or another size than expected, are an error."""
    d = zlib.decompressobj()
    try:
        out = d.decompress(data) + d.flush()
    except zlib.error as e:
        raise FormatError(f"deflate: {e}") from e
    if not d.eof or d.unused_data:
        raise FormatError("deflate: stream and data end in different places")
    if size is not None and len(out) != size:
        raise FormatError(f"deflate: {len(out)} bytes, {size} expected")
    return out


def fletcher32(data: bytes) -> int:
    """Checksum over big-endian 16-bit words; an odd last byte is the high half of a word."""
    words = np.frombuffer(data + b"\0" * (len(data) % 2), ">u2").astype(np.uint64)
    a = b = np.uint64(0)
    mod = np.uint64(65535)
    for at in range(0, len(words), 4096):
        w = words[at : at + 4096]
        n = np.uint64(len(w))
        # sums of sums: word k counts once for each word from it to the end of the block
        b = (b + n * a + (w * np.arange(len(w), 0, -1, dtype=np.uint64)).sum()) % mod
        a = (a + w.sum()) % mod
    return (int(b) << 16) | int(a)


def add_checksum(data: bytes) -> bytes:
    return data + fletcher32(data).to_bytes(4, "little")


def check_checksum(data: bytes) -> bytes:
    """The data without its checksum; an old form with the bytes of each half swapped is accepted."""
    if len(data) < 4:
        raise FormatError("checksum: too few bytes")
    body, stored = data[:-4], int.from_bytes(data[-4:], "little")
    want = fletcher32(body)
    swapped = ((want & 0xFF00FF00) >> 8) | ((want & 0x00FF00FF) << 8)
    # 0 and 65535 are the same remainder
    same = lambda v: all((x - y) % 65535 == 0 for x, y in ((v >> 16, stored >> 16), (v & 0xFFFF, stored & 0xFFFF)))
    if not (same(want) or same(swapped)):
        raise FormatError("checksum differs")
    return body


def lzf(data: bytes) -> bytes:
    """LZF tokens for data: the last place of every three bytes proposes a copy, all else is literal."""
    out, start, at, last = bytearray(), 0, 0, {}

    def literals(end: int) -> None:
        for s in range(start, end, 32):
            part = data[s : min(end, s + 32)]
            out.append(len(part) - 1)
            out.extend(part)

    while at + 2 < len(data):
        key = data[at : at + 3]
        seen, last[key] = last.get(key), at
        if seen is None or at - seen > 8192:
            at += 1
            continue
        n = 3
        while n < 264 and at + n < len(data) and data[seen + n] == data[at + n]:
            n += 1
        literals(at)
        back, n_ = at - seen - 1, n - 2
        out.append(min(n_, 7) << 5 | back >> 8)
        if n_ >= 7:
            out.append(n_ - 7)
        out.append(back & 255)
        at += n
        start = at
    literals(len(data))
    return bytes(out)


def unlzf(data: bytes, size: int) -> bytes:
    """LZF: runs of literals, and copies of what was written up to 8 KiB before."""
    out = bytearray()
    at = 0
    try:
        while at < len(data):
            c = data[at]
            at += 1
            if c < 32:
                if at + c + 1 > len(data):
                    raise FormatError("lzf: literals run past the end")
                out += data[at : at + c + 1]
                at += c + 1
                continue
            n = c >> 5
            if n == 7:
                n += data[at]
                at += 1
            back = ((c & 31) << 8) + data[at] + 1
            at += 1
            if back > len(out):
                raise FormatError("lzf: copy from before the start")
            for _ in range(n + 2):
                out.append(out[-back])
    except IndexError as e:
        raise FormatError("lzf: data ends inside a token") from e
    if len(out) != size:
        raise FormatError(f"lzf: {len(out)} bytes, {size} expected")
    return bytes(out)


def pack_bits(values: Sequence[int], width: int) -> bytes:
    """Unsigned numbers of ``width`` bits each, high bit first, without gaps."""
    if width == 0 or not len(values):
        return b""
    v = np.asarray(values, np.uint64)
    bits = (v[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    if width == 0:
        return np.zeros(n, np.uint64)
    if len(data) * 8 < n * width:
        raise FormatError("packed numbers end too soon")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width).astype(np.uint64)
    return (bits << np.arange(width - 1, -1, -1, dtype=np.uint64)).sum(1, dtype=np.uint64)


@dataclass(frozen=True)
class Bits:
    """The used bits of one number inside its ``size`` bytes."""

    size: int
    precision: int
    offset: int = 0
    big_endian: bool = False


def nbit_pack(data: bytes, members: Sequence[Bits]) -> bytes:
    """Records of numbers, of each only the used bits, without gaps."""
    step = sum(m.size for m in members)
    n = len(data) // step if step else 0
    rows = np.frombuffer(data, np.uint8, n * step).reshape(n, step)
    out, at = [], 0
    for m in members:
        raw = rows[:, at : at + m.size]
        at += m.size
        le = raw[:, ::-1] if m.big_endian else raw
        v = (le.astype(np.uint64) << (np.arange(m.size, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64) >> np.uint64(m.offset)
        out.append(((v[:, None] >> np.arange(m.precision - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8))
    return np.packbits(np.concatenate(out, 1).ravel()).tobytes() if n else b""


def nbit_unpack(data: bytes, members: Sequence[Bits], n: int) -> bytes:
    width = sum(m.precision for m in members)
    if len(data) * 8 < n * width:
        raise FormatError("nbit: data end too soon")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width).astype(np.uint64)
    cols, at = [], 0
    for m in members:
        v = (bits[:, at : at + m.precision] << np.arange(m.precision - 1, -1, -1, dtype=np.uint64)).sum(1, dtype=np.uint64) << np.uint64(m.offset)
        at += m.precision
        le = ((v[:, None] >> (np.arange(m.size, dtype=np.uint64) * np.uint64(8))) & np.uint64(255)).astype(np.uint8)
        cols.append(le[:, ::-1] if m.big_endian else le)
    return np.concatenate(cols, 1).tobytes() if n else b""


def scale_offset_pack(values: np.ndarray, fill: int | None = None) -> tuple[int, int, bytes]:
    """(smallest value, bits, packed) of integers; the all-ones pattern stands for the fill value."""
    v = [int(x) for x in values]
    real = [x for x in v if x != fill]
    low = min(real, default=0)
    span = max(real, default=0) - low
    bits = (span + (fill is not None)).bit_length() if span or fill is not None else 0
    ones = (1 << bits) - 1
    return low, bits, pack_bits([ones if x == fill else x - low for x in v], bits)


def scale_offset_unpack(low: int, bits: int, data: bytes, n: int, fill: int | None = None) -> list[int]:
    ones = (1 << bits) - 1
    return [fill if fill is not None and bits and int(x) == ones else low + int(x) for x in unpack_bits(data, bits, n)]


def scale_offset_pack_floats(values: np.ndarray, decimals: int) -> tuple[float, int, bytes]:
    low = float(values.min()) if len(values) else 0.0
    k = np.floor((values.astype(np.float64) - low) * 10.0**decimals + 0.5).astype(np.uint64)
    bits = int(k.max()).bit_length() if len(k) else 0
    return low, bits, pack_bits(k, bits)


def scale_offset_unpack_floats(low: float, bits: int, data: bytes, n: int, decimals: int) -> np.ndarray:
    return unpack_bits(data, bits, n).astype(np.float64) / 10.0**decimals + low


def lookup3(data: bytes, start: int = 0) -> int:
    """The public-domain lookup3 hash, little-endian form: the checksum of metadata blocks."""
    mask = 0xFFFFFFFF
    rot = lambda x, k: ((x << k) | (x >> (32 - k))) & mask
    a = b = c = (0xDEADBEEF + len(data) + start) & mask
    at, left = 0, len(data)
    while left > 12:
        a = (a + int.from_bytes(data[at : at + 4], "little")) & mask
        b = (b + int.from_bytes(data[at + 4 : at + 8], "little")) & mask
        c = (c + int.from_bytes(data[at + 8 : at + 12], "little")) & mask
        for k, (x, y) in zip((4, 6, 8, 16, 19, 4), ((0, 2), (1, 0), (2, 1)) * 2):
            v = [a, b, c]
            z = 3 - x - y
            v[x] = ((v[x] - v[y]) & mask) ^ rot(v[y], k)
            v[y] = (v[y] + v[z]) & mask
            a, b, c = v
        at, left = at + 12, left - 12
    if not left:
        return c
    tail = data[at:] + b"\0" * (12 - left)
    a = (a + int.from_bytes(tail[:4], "little")) & mask
    b = (b + int.from_bytes(tail[4:8], "little")) & mask
    c = (c + int.from_bytes(tail[8:], "little")) & mask
    for x, y, k in ((2, 1, 14), (0, 2, 11), (1, 0, 25), (2, 1, 16), (0, 2, 4), (1, 0, 14), (2, 1, 24)):
        v = [a, b, c]
        v[x] = ((v[x] ^ v[y]) - rot(v[y], k)) & mask
        a, b, c = v
    return c


@dataclass(frozen=True)
class Filter:
    name: str
    options: dict = field(default_factory=dict)


Codec = tuple[Callable[[bytes, dict], bytes] | None, Callable[[bytes, dict], bytes]]


class Registry:
    """Codecs by name: (encode or None, decode)."""

    def __init__(self):
        self._codecs: dict[str, Codec] = {}

    def register(self, name: str, encode: Callable[[bytes, dict], bytes] | None, decode: Callable[[bytes, dict], bytes]) -> None:
        self._codecs[name] = (encode, decode)

    def unregister(self, name: str) -> None:
        if self._codecs.pop(name, None) is None:
            raise UnsupportedError(f"no filter {name}")

    def available(self, name: str) -> bool:
        return name in self._codecs

    def find(self, name: str) -> Codec:
        if name not in self._codecs:
            raise UnsupportedError(f"no filter {name}")
        return self._codecs[name]


REGISTRY = Registry()
REGISTRY.register("shuffle", lambda b, o: shuffle(b, o["size"]), lambda b, o: unshuffle(b, o["size"]))
REGISTRY.register("deflate", lambda b, o: deflate(b, o.get("level", 6)), lambda b, o: inflate(b))
REGISTRY.register("fletcher32", lambda b, o: add_checksum(b), lambda b, o: check_checksum(b))
REGISTRY.register("lzf", lambda b, o: lzf(b), lambda b, o: unlzf(b, o["bytes"]))
REGISTRY.register("nbit", lambda b, o: nbit_pack(b, o["members"]), lambda b, o: nbit_unpack(b, o["members"], o["n"]))


@dataclass(frozen=True)
class Pipeline:
    filters: tuple[Filter, ...] = ()

    def __post_init__(self):
        if len(self.filters) > MAX_FILTERS:
            raise FormatError(f"over {MAX_FILTERS} filters")

    def append(self, f: Filter) -> Pipeline:
        return Pipeline((*self.filters, f))

    def modify(self, name: str, options: dict) -> Pipeline:
        return Pipeline(tuple(Filter(name, options) if f.name == name else f for f in self.filters))

    def delete(self, name: str) -> Pipeline:
        return Pipeline(tuple(f for f in self.filters if f.name != name))

    def encode(self, data: bytes, registry: Registry = REGISTRY) -> bytes:
        for f in self.filters:
            enc, _ = registry.find(f.name)
            if enc is None:
                raise UnsupportedError(f"{f.name} is read only")
            data = enc(data, f.options)
        return data

    def decode(self, data: bytes, size: int, mask: int = 0, registry: Registry = REGISTRY) -> bytes:
        if mask >> len(self.filters):
            raise FormatError("mask for filters that are not there")
        for i in range(len(self.filters) - 1, -1, -1):
            if not mask >> i & 1:
                data = registry.find(self.filters[i].name)[1](data, self.filters[i].options)
        if len(data) != size:
            raise FormatError(f"{len(data)} bytes after the filters, {size} expected")
        return data


def _over_rows(df: DataFrame, column: str, f: Callable[[dict], bytes], needed: Sequence[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in needed]
            out = pa.array([f(dict(zip(needed, r))) for r in zip(*cols)], pa.binary())
            i = b.schema.get_field_index(column)
            yield pa.RecordBatch.from_arrays([out if k == i else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def encode_chunks(df: DataFrame, pipeline: Pipeline, column: str = "bytes") -> DataFrame:
    """Chunk rows with their bytes encoded."""
    return _over_rows(df, column, lambda r: pipeline.encode(r[column]), [column])


def decode_chunks(df: DataFrame, pipeline: Pipeline, size: str = "size", mask: str = "mask", column: str = "bytes") -> DataFrame:
    """Chunk rows with their bytes decoded; columns ``size`` and ``mask`` say what each chunk must give and which filters it skipped."""
    return _over_rows(df, column, lambda r: pipeline.decode(r[column], r[size], r[mask]), [column, size, mask])
