"""Shapes of arrays: null, scalar, or simple with current and largest dimensions."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from .errors import FormatError

UNLIMITED = None
MAX_RANK = 32


@dataclass(frozen=True)
class Shape:
    """``dims`` of None is the null shape (no element); () is a scalar (one element)."""

    dims: tuple[int, ...] | None
    max_dims: tuple[int | None, ...] | None = None

    def __post_init__(self):
        if self.dims is None:
            return
        if len(self.dims) > MAX_RANK:
            raise FormatError(f"rank {len(self.dims)} is over {MAX_RANK}")
        if any(d < 0 for d in self.dims):
            raise FormatError("negative dimension")
        if self.max_dims is not None:
            if len(self.max_dims) != len(self.dims):
                raise FormatError("largest dimensions of another rank")
            if any(m is not None and m < d for d, m in zip(self.dims, self.max_dims)):
                raise FormatError("dimension above its largest")

    @classmethod
    def null(cls) -> Shape:
        return cls(None)

    @classmethod
    def scalar(cls) -> Shape:
        return cls(())

    @property
    def rank(self) -> int:
        return len(self.dims or ())

    @property
    def is_null(self) -> bool:
        return self.dims is None

    @property
    def size(self) -> int:
        return 0 if self.dims is None else prod(self.dims)

    @property
    def largest(self) -> tuple[int | None, ...]:
        return self.max_dims if self.max_dims is not None else (self.dims or ())

    @property
    def max_size(self) -> int | None:
        """Elements at the largest dimensions; None if unlimited."""
        return None if any(m is None for m in self.largest) else (0 if self.is_null else prod(self.largest))

    @property
    def is_resizable(self) -> bool:
        return any(m is None or m > d for d, m in zip(self.dims or (), self.largest))

    def resized(self, dims: tuple[int, ...]) -> Shape:
        if self.is_null or len(dims) != self.rank:
            raise FormatError("resize needs the same rank")
        if any(m is not None and d > m for d, m in zip(dims, self.largest)):
            raise FormatError("dimension above its largest")
        return Shape(tuple(dims), self.largest)

    @property
    def strides(self) -> tuple[int, ...]:
        """Row-major steps of each axis."""
        out, step = [], 1
        for d in reversed(self.dims or ()):
            out.append(step)
            step *= d
        return tuple(reversed(out))
