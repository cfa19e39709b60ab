"""Vectorised UTF-8 tokenising over Arrow string columns.

All word classes used here are sets of ASCII bytes, so a text can be cut on its UTF-8 bytes: bytes
from 0x80 belong to non-ASCII characters and are always word bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
PIECE = 1 << 18
_P = 0x9E3779B97F4A7C15
_state: dict[str, np.ndarray] = {}


def space_words() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def letter_words() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


def fold_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _state:
        inv = pow(_P, -1, 1 << 64)
        for key, base in (("p", _P), ("i", inv)):
            a = np.full(PIECE + 1, base, U64)
            a[0] = 1
            _state[key] = np.cumprod(a, dtype=U64)
    return _state["p"], _state["i"]


def _values(fold: bool) -> np.ndarray:
    key = f"v{fold}"
    if key not in _state:
        v = mix(np.arange(1, 257, dtype=U64) * U64(_P))
        _state[key] = v[fold_table()] if fold else v
    return _state[key]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(batch: pa.RecordBatch, name: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into row ranges of about ``limit`` text bytes, so that memory does not follow the batch."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(name))
    _, offs = utf8(col)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        to = min(to, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of several texts: byte ranges ``start``/``end`` and for text ``i`` words ``first[i]:first[i+1]``."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray):
        self.buf, self.offs = buf, offs
        mask = is_word[buf]
        prev = np.empty_like(mask)
        if len(mask):
            prev[1:] = mask[:-1]
            prev[0] = False
            inner = offs[:-1][offs[:-1] < len(buf)]
            prev[inner] = False
        self.start = np.flatnonzero(mask & ~prev)
        nxt = np.empty_like(mask)
        if len(mask):
            nxt[:-1] = mask[1:]
            nxt[-1] = False
            last = offs[1:][offs[1:] > 0] - 1
            nxt[last] = False
        self.end = np.flatnonzero(mask & ~nxt) + 1
        self.first = np.searchsorted(self.start, offs)

    def hashes(self, fold: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, A-Z lower-cased if ``fold``."""
        p, inv = _powers()
        val = _values(fold)
        s, e = self.start, self.end
        out = np.empty(len(s), U64)
        i = 0
        while i < len(s):
            j = int(np.searchsorted(e, s[i] + PIECE, "right"))
            if j <= i:  # one word longer than a piece
                raw = self.buf[s[i] : e[i]]
                out[i] = xxhash.xxh64_intdigest((fold_table()[raw] if fold else raw).tobytes())
                i += 1
                continue
            base = s[i]
            seg = val[self.buf[base : e[j - 1]]]
            seg *= p[: len(seg)]
            cs = np.empty(len(seg) + 1, U64)
            cs[0] = 0
            np.cumsum(seg, out=cs[1:])
            a, b = s[i:j] - base, e[i:j] - base
            out[i:j] = (cs[b] - cs[a]) * inv[a]
            i = j
        return mix(out)


def grams(h: np.ndarray, first: np.ndarray, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and their ``first`` offsets; with ``whole``, a shorter non-empty text is one shingle.

    Shingles are in text order and may repeat.
    """
    n = np.diff(first)
    many = np.maximum(n - k + 1, 0)
    count = np.where((many == 0) & (n > 0), 1, many) if whole else many
    at = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(n)), count)
    pos = np.arange(at[-1]) - at[owner] + first[owner]
    out = np.zeros(at[-1], U64)
    long = n[owner] >= k
    m = U64(0xD6E8FEB86659FD93)
    lp = pos[long]
    acc = np.full(len(lp), U64(k))
    for j in range(k):
        acc = (acc ^ h[lp + j]) * m
        acc ^= acc >> U64(29)
    out[long] = acc
    for i in np.flatnonzero(~long):
        o = owner[i]
        acc = int(n[o]) + 0x1234
        for x in h[first[o] : first[o + 1]]:
            acc = ((acc ^ int(x)) * int(m)) & 0xFFFFFFFFFFFFFFFF
            acc ^= acc >> 29
        out[i] = acc
    return mix(out), at
