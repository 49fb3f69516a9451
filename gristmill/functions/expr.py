"""Boolean and arithmetic rule expressions, parsed to a tree and compiled to one Column.

Operators by falling precedence: ``!``; ``* /``; ``+ -``; comparisons; ``&``;
``|``. ``&&``, ``||``, ``and``, ``or`` and ``not`` are synonyms. Chains of one
associative operator become one n-ary node. In postfix form the operands of
``&`` and ``|`` are in order of their number of atoms. An atom is any other word; one that
begins with ``-`` and follows an operator belongs to the atom.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(&&|\|\||<=|>=|==|!=|[&|!<>+*/()]|-(?=\s|\())|([A-Za-z0-9_.:~^@-]+(?:\[[^\]]*\])?))")
_WORDS = {"and": "&", "or": "|", "not": "!", "&&": "&", "||": "|"}
_LEVELS = [("|",), ("&",), ("<", ">", "<=", ">=", "==", "!="), ("+", "-"), ("*", "/")]
_CHAINED = {"|", "&", "+", "*"}


class ExpressionError(ValueError):
    """The text is not an expression."""


@dataclass
class Node:
    """An operator with its operands, or an atom (``op`` is None)."""

    op: str | None
    text: str = ""
    items: list[Node] = field(default_factory=list)

    def postfix(self) -> str:
        if self.op is None:
            return self.text if re.fullmatch(r"\d+(\.\d+)?", self.text) and self.bare else f"({self.text})"
        count = f"({len(self.items)})" if len(self.items) > 2 or (self.op == "+" and len(self.items) > 2) else ""
        items = sorted(self.items, key=lambda i: len(i.atoms())) if self.op in ("&", "|") else self.items
        return " ".join([*(i.postfix() for i in items), self.op + count])

    bare: bool = False

    def atoms(self) -> list[str]:
        return [self.text] if self.op is None else [a for i in self.items for a in i.atoms()]


def parse(text: str) -> Node:
    """The tree of an expression; raises ExpressionError if it is malformed."""
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected text at {at}: {text[at:]!r}")
        word = m[1] or m[2]
        tokens.append((_WORDS.get(word.lower(), word), m[1] is None and word.lower() not in _WORDS))
        at = m.end()
    place = 0

    def peek() -> str | None:
        return tokens[place][0] if place < len(tokens) and not tokens[place][1] else None

    def take() -> tuple[str, bool]:
        nonlocal place
        if place >= len(tokens):
            raise ExpressionError("the expression ends too early")
        place += 1
        return tokens[place - 1]

    def unary() -> Node:
        word, atom = take()
        if atom:
            return Node(None, word)
        if word == "!":
            return Node("!", items=[unary()])
        if word == "(":
            inside = level(0)
            if take()[0] != ")":
                raise ExpressionError("a bracket is not closed")
            return inside
        raise ExpressionError(f"unexpected {word!r}")

    def level(k: int) -> Node:
        if k == len(_LEVELS):
            return unary()
        left = level(k + 1)
        while peek() in _LEVELS[k]:
            op = take()[0]
            right = level(k + 1)
            if right.op is None and k == 2:
                right.bare = True
            if op in _CHAINED and left.op == op and not getattr(left, "closed", False):
                left.items.append(right)
            else:
                left = Node(op, items=[left, right])
        return left

    out = level(0)
    if place != len(tokens):
        raise ExpressionError(f"unexpected {tokens[place][0]!r}")
    return out


def compile_expression(tree: Node, atom: Callable[[str], Column]) -> Column:
    """A double Column with the expression's value.

    ``atom`` gives an atom's value; numbers are constants. A lone ``|`` or ``&``
    yields 1 or 0; division by zero yields null.
    """
    if tree.op is None:
        return F.lit(float(tree.text)) if re.fullmatch(r"-?\d+(\.\d+)?", tree.text) else atom(tree.text).cast("double")
    items = [compile_expression(i, atom) for i in tree.items]
    one, zero = F.lit(1.0), F.lit(0.0)
    if tree.op == "!":
        return F.when(items[0] == 0, one).otherwise(zero)
    if tree.op == "&":
        return F.when(reduce(lambda a, b: a & b, [i != 0 for i in items]), one).otherwise(zero)
    if tree.op == "|":
        return F.when(reduce(lambda a, b: a | b, [i != 0 for i in items]), one).otherwise(zero)
    if tree.op in ("+", "*"):
        return reduce(lambda a, b: a + b if tree.op == "+" else a * b, items)
    a, b = items
    simple = {"-": lambda: a - b, "/": lambda: F.try_divide(a, b)}
    if tree.op in simple:
        return simple[tree.op]()
    compare = {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "==": a == b, "!=": a != b}
    return F.when(compare[tree.op], one).otherwise(zero)


def evaluate(text: str, atoms: dict[str, Column]) -> Column:
    """Parse and compile; an atom that is not given is 0, and ``-name`` is the negated atom."""

    def value(name: str) -> Column:
        if name in atoms:
            return atoms[name]
        return -atoms[name[1:]].cast("double") if name.startswith("-") and name[1:] in atoms else F.lit(0)

    return compile_expression(parse(text), value)
