"""Exact integer arithmetic: operands widen to BIGINT first, division truncates, overflow and division by zero raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATIONS = ("+", "-", "*", "/")


def whole(value: Column | int) -> Column:
    return value.cast("bigint") if isinstance(value, Column) else F.lit(value).cast("bigint")


def operate(op: str, *values: Column | int) -> Column:
    """values[0] op values[1] op ..., from the left."""
    if op not in OPERATIONS or not values:
        raise ValueError(f"no operation {op!r} on {len(values)} operands")
    wide = [whole(v) for v in values]
    if len(wide) == 1:
        if op != "-":
            raise ValueError(f"{op!r} needs two operands")
        return -wide[0]
    apply = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": truncated}[op]
    return reduce(apply, wide)


def truncated(a: Column, b: Column) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", a, b)
