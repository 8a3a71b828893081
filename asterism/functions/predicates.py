"""Predicates: comparisons, AND and OR trees, and searches over ranges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the comparisons.
COMPARISONS = {"=": "=", "==": "=", "<>": "<>", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def compare(op: str, a: Column | int, b: Column | int) -> Column:
    """a op b; either side can be a literal.  Unknown operators raise."""
    if op not in COMPARISONS:
        raise ValueError(f"no comparison {op!r}")
    left = a if isinstance(a, Column) else F.lit(a)
    right = b if isinstance(b, Column) else F.lit(b)
    return {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[COMPARISONS[op]]


def logical(op: str, parts: Sequence[Column]) -> Column:
    if op.upper() not in ("AND", "OR") or not parts:
        raise ValueError(f"no logical operation {op!r} on {len(parts)} operands")
    return reduce((lambda a, b: a & b) if op.upper() == "AND" else (lambda a, b: a | b), parts)


@dataclass(frozen=True)
class Range:
    """An interval; None: unbounded."""

    low: int | None = None
    high: int | None = None
    low_closed: bool = True
    high_closed: bool = True

    @property
    def point(self) -> bool:
        return self.low is not None and self.low == self.high and self.low_closed and self.high_closed


def search(value: Column, ranges: Sequence[Range]) -> Column:
    """Whether value lies in one of the ranges; points become one IN list, which the scan can use."""
    points = [r.low for r in ranges if r.point]
    parts = [value == F.lit(points[0]) if len(points) == 1 else value.isin(points)] if points else []
    for r in ranges:
        if r.point:
            continue
        ends = []
        if r.low is not None:
            ends.append(value >= F.lit(r.low) if r.low_closed else value > F.lit(r.low))
        if r.high is not None:
            ends.append(value <= F.lit(r.high) if r.high_closed else value < F.lit(r.high))
        parts.append(logical("AND", ends) if ends else value.isNotNull())
    return logical("OR", parts) if parts else F.lit(False)
