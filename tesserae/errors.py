"""Errors, raised on the driver before a plan is built."""


class ArrayError(Exception):
    """Any error of the engine."""


class FormatError(ArrayError, ValueError):
    """Data or metadata that contradicts itself."""


class UnsupportedError(ArrayError, NotImplementedError):
    """A request the engine does not serve."""


class SelectionError(ArrayError, IndexError):
    """A selection that does not fit its array."""
