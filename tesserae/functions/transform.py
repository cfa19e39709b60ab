"""Arithmetic transform expressions of one variable, parsed to a Column.

    expr := term (('+' | '-') term)*      term := factor (('*' | '/') factor)*
    factor := number | x | '-' factor | '+' factor | '(' expr ')'

Evaluation is in doubles; a division by zero fails.  Text never reaches Spark's own SQL parser.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FormatError

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([xX])|([-+*/()]))")


@dataclass(frozen=True)
class Node:
    op: str  # "num", "x", "neg", or an operator
    value: float = 0.0
    args: tuple[Node, ...] = ()

    def column(self, x: Column) -> Column:
        if self.op == "num":
            return F.lit(self.value)
        if self.op == "x":
            return x.cast("double")
        if self.op == "neg":
            return -self.args[0].column(x)
        a, b = (n.column(x) for n in self.args)
        if self.op == "/":
            return F.when(b == 0, F.raise_error(F.lit("division by zero in a transform")).cast("double")).otherwise(F.try_divide(a, b))
        return {"+": a + b, "-": a - b, "*": a * b}[self.op]

    def evaluate(self, x: float) -> float:
        if self.op == "num":
            return self.value
        if self.op == "x":
            return float(x)
        if self.op == "neg":
            return -self.args[0].evaluate(x)
        a, b = (n.evaluate(x) for n in self.args)
        if self.op == "/":
            if b == 0:
                raise FormatError("division by zero in a transform")
            return a / b
        return {"+": a + b, "-": a - b, "*": a * b}[self.op]

    @property
    def is_constant(self) -> bool:
        return self.op == "num" or self.op != "x" and all(a.is_constant for a in self.args)

    def folded(self) -> Node:
        """With constant parts computed; a division by a constant zero is left for evaluation."""
        if not self.args:
            return self
        node = Node(self.op, self.value, tuple(a.folded() for a in self.args))
        if not node.is_constant or node.op == "/" and node.args[1].op == "num" and node.args[1].value == 0:
            return node
        return Node("num", node.evaluate(0.0))


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormatError(f"unexpected {text[at]!r} in a transform")
        out.append(m[1] or (m[2] and "x") or m[3])
        at = m.end()
    return out


def parse(text: str) -> Node:
    todo = tokens(text)[::-1]
    if not todo:
        raise FormatError("empty transform")

    def chain(part, ops: str) -> Node:
        node = part()
        while todo and todo[-1] in ops:
            op = todo.pop()
            node = Node(op, 0.0, (node, part()))
        return node

    def expr() -> Node:
        return chain(term, "+-")

    def term() -> Node:
        return chain(factor, "*/")

    def factor() -> Node:
        if not todo:
            raise FormatError("a transform ends too soon")
        t = todo.pop()
        if t == "x":
            return Node("x")
        if t == "-":
            return Node("neg", 0.0, (factor(),))
        if t == "+":
            return factor()
        if t == "(":
            inner = expr()
            if not todo or todo.pop() != ")":
                raise FormatError("a bracket is not closed")
            return inner
        if t in "*/)":
            raise FormatError(f"unexpected {t!r} in a transform")
        return Node("num", float(t))

    out = expr()
    if todo:
        raise FormatError(f"unexpected {todo[-1]!r} in a transform")
    return out


def apply(text: str, x: Column) -> Column:
    """The transform of a column."""
    return parse(text).folded().column(x)
