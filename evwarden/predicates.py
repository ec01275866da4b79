"""Predicates over sequence aliases.

``attr("pc1.ProductId") == attr("pb.ProductId")`` builds a small expression
object.  It has two evaluators: :func:`to_column` gives a Spark ``Column`` and
:func:`to_mask` gives a numpy mask for the vectorised matcher.  A comparison
that touches a missing member is false, never null, so OR keeps working.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {
    "=": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}


class Predicate:
    """Base of comparisons and of AND / OR over them."""

    def __and__(self, other: Predicate) -> Predicate:
        return Junction("and", (self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Junction("or", (self, other))

    def __bool__(self) -> bool:
        raise TypeError("combine predicates with & and |, not with and / or")


class _Operand:
    def __eq__(self, other: Any) -> Predicate:  # type: ignore[override]
        return Comparison("=", self, _operand(other))

    def __ne__(self, other: Any) -> Predicate:  # type: ignore[override]
        return Comparison("!=", self, _operand(other))

    def __lt__(self, other: Any) -> Predicate:
        return Comparison("<", self, _operand(other))

    def __le__(self, other: Any) -> Predicate:
        return Comparison("<=", self, _operand(other))

    def __gt__(self, other: Any) -> Predicate:
        return Comparison(">", self, _operand(other))

    def __ge__(self, other: Any) -> Predicate:
        return Comparison(">=", self, _operand(other))

    __hash__ = None  # type: ignore[assignment]


class Ref(_Operand):
    """A member of an alias, e.g. ``a.price`` or ``a.customer.id``."""

    def __init__(self, alias: str, path: str):
        self.alias, self.path = alias, path

    def __repr__(self) -> str:
        return f"{self.alias}.{self.path}"


class Literal(_Operand):
    def __init__(self, value: Any):
        self.value = value

    def __repr__(self) -> str:
        return repr(self.value)


def attr(name: str) -> Ref:
    """``attr("alias.member")``; everything after the first dot is the path."""
    alias, dot, path = name.partition(".")
    if not (alias and dot and path):
        raise ValueError(f"expected 'alias.member', got {name!r}")
    return Ref(alias, path)


def _operand(value: Any) -> _Operand:
    return value if isinstance(value, _Operand) else Literal(value)


@dataclass(frozen=True, eq=False)
class Comparison(Predicate):
    op: str
    left: _Operand
    right: _Operand

    def __repr__(self) -> str:
        return f"({self.left!r} {self.op} {self.right!r})"


@dataclass(frozen=True, eq=False)
class Junction(Predicate):
    op: str
    parts: tuple[Predicate, ...]

    def __repr__(self) -> str:
        return "(" + f" {self.op} ".join(map(repr, self.parts)) + ")"


def comparisons(pred: Predicate) -> Iterator[Comparison]:
    if isinstance(pred, Comparison):
        yield pred
    else:
        for part in pred.parts:
            yield from comparisons(part)


def refs(pred: Predicate) -> Iterator[Ref]:
    for cmp in comparisons(pred):
        for side in (cmp.left, cmp.right):
            if isinstance(side, Ref):
                yield side


def aliases_of(pred: Predicate) -> set[str]:
    return {r.alias for r in refs(pred)}


def conjuncts(pred: Predicate) -> list[Predicate]:
    """Top-level AND split into its parts."""
    if isinstance(pred, Junction) and pred.op == "and":
        return [c for part in pred.parts for c in conjuncts(part)]
    return [pred]


def to_column(pred: Predicate, leaf: Callable[[Comparison], Column]) -> Column:
    """Boolean tree over ``leaf``, which must never yield null."""
    if isinstance(pred, Comparison):
        return leaf(pred)
    cols = [to_column(p, leaf) for p in pred.parts]
    out = cols[0]
    for c in cols[1:]:
        out = out & c if pred.op == "and" else out | c
    return out


def compare(op: str, left: Column, right: Column) -> Column:
    """One comparison; false when a side is missing."""
    return F.coalesce(_OPS[op](left, right), F.lit(False))


def to_mask(pred: Predicate, value: Callable[[_Operand], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Numpy evaluation; ``value`` yields (values, present) for an operand."""
    if isinstance(pred, Comparison):
        lv, lok = value(pred.left)
        rv, rok = value(pred.right)
        return _compare_arrays(pred.op, lv, rv) & lok & rok
    out = to_mask(pred.parts[0], value)
    for part in pred.parts[1:]:
        more = to_mask(part, value)
        out = out & more if pred.op == "and" else out | more
    return out


def _compare_arrays(op: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    if left.dtype.kind != "f" and right.dtype.kind != "f":
        return np.asarray(_OPS[op](left, right), dtype=bool)
    # NaN equals itself and is above every number, as in Spark SQL.
    lnan, rnan = np.isnan(left), np.isnan(right)
    eq = (left == right) | (lnan & rnan)
    lt = (left < right) | (~lnan & rnan)
    if op == "=":
        return eq
    if op == "!=":
        return ~eq
    if op == "<":
        return lt
    if op == "<=":
        return lt | eq
    return ~(lt | eq) if op == ">" else ~lt
