"""Predicates over annotations, as a small tree that becomes one Spark column."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)

    def column(self, a: Column) -> Column:
        """True, or false, never null, for an annotations column."""
        raise NotImplementedError


#: The spellings of each comparison.
COMPARISONS = {"=": "=", "==": "=", "!=": "<>", "<>": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "like": "like", "~": "regex", "regex": "regex", "regexp": "regex"}


@dataclass(frozen=True)
class Compare(Predicate):
    """``key op 'text'``. Values compare as text. An element without the key never matches, not even ``<>``. The key ``*`` stands for any annotation."""

    key: str
    op: str
    value: str

    def column(self, a: Column) -> Column:
        op = COMPARISONS[self.op.lower()]
        tests = {
            "=": lambda v: v == self.value,
            "<>": lambda v: v != self.value,
            "<": lambda v: v < self.value,
            "<=": lambda v: v <= self.value,
            ">": lambda v: v > self.value,
            ">=": lambda v: v >= self.value,
            "like": lambda v: v.like(self.value),
            "regex": lambda v: v.rlike(self.value),
        }
        test = tests[op]
        if self.key == "*":
            return F.coalesce(F.exists(F.map_values(a), lambda v: F.coalesce(test(v), F.lit(False))), F.lit(False))
        return F.coalesce(test(a[self.key]), F.lit(False))

    def __str__(self) -> str:
        return f"(\"{self.key}\" {COMPARISONS[self.op.lower()]} '{self.value}')"


@dataclass(frozen=True)
class And(Predicate):
    left: Predicate
    right: Predicate

    def column(self, a: Column) -> Column:
        return self.left.column(a) & self.right.column(a)

    def __str__(self) -> str:
        return f"({self.left} and {self.right})"


@dataclass(frozen=True)
class Or(Predicate):
    left: Predicate
    right: Predicate

    def column(self, a: Column) -> Column:
        return self.left.column(a) | self.right.column(a)

    def __str__(self) -> str:
        return f"({self.left} or {self.right})"


@dataclass(frozen=True)
class Not(Predicate):
    """The complement: elements without the key match."""

    of: Predicate

    def column(self, a: Column) -> Column:
        return ~self.of.column(a)

    def __str__(self) -> str:
        return f"(not {self.of})"


def has_keys(a: Column, keys: list[str]) -> Column:
    """All keys are there with a value."""
    return reduce(lambda x, y: x & y, [F.coalesce(a[k].isNotNull(), F.lit(False)) for k in keys], F.lit(True))
