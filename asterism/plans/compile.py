"""Compiles a plan into one lazy DataFrame; Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arith import OPERATIONS, operate
from ..functions.predicates import COMPARISONS, compare, logical, search
from .ir import Aggregate, Call, Col, Expr, Filter, Join, Lit, Measure, Plan, Project, Scan, Search, Sort
from .usage import order

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def _column(names: list[str | None], index: int) -> Column:
    if not 0 <= index < len(names) or names[index] is None:
        raise ValueError(f"no column at position {index}")
    return F.col(names[index])


def _expression(expr: Expr, names: list[str]) -> Column:
    if isinstance(expr, Col):
        return _column(names, expr.index)
    if isinstance(expr, Lit):
        return F.lit(expr.value)
    if isinstance(expr, Search):
        return search(_expression(expr.value, names), expr.ranges)
    if not isinstance(expr, Call):
        raise ValueError(f"no expression {expr!r}")
    args = [_expression(a, names) for a in expr.args]
    if expr.op.upper() in ("AND", "OR"):
        return logical(expr.op, args)
    if expr.op.upper() == "NOT":
        return ~args[0]
    if expr.op in OPERATIONS:
        return operate(expr.op, *args)
    if expr.op in COMPARISONS and len(args) == 2:
        return compare(expr.op, *args)
    raise ValueError(f"no operator {expr.op!r} on {len(args)} operands")


def _measure(m: Measure, names: list[str], zero: bool) -> Column:
    value = F.lit(1) if m.arg is None else _column(names, m.arg)
    kind = m.function.upper()
    if kind == "COUNT":
        out = F.countDistinct(value) if m.distinct else F.count(value)
    elif kind == "SUM":
        out = F.sum_distinct(value) if m.distinct else F.sum(value)
        out = F.coalesce(out, F.lit(0)) if zero else out
        out = out.cast("bigint")
    elif kind in ("MIN", "MAX", "AVG"):
        out = {"MIN": F.min, "MAX": F.max, "AVG": F.avg}[kind](value)
    else:
        raise ValueError(f"no aggregate {m.function!r}")
    return out


def compile_plan(plan: Plan, table: Callable[[str, list[str]], DataFrame], fact: str = "lineorder") -> DataFrame:
    """The last node's rows.  table(name, columns) gives a base table; columns are renamed by node inside, so that a table may occur twice.

    Nodes are compiled as order() says; those that the last one does not read are left out.
    """
    made: dict[int, tuple[DataFrame, list[str], list[str]]] = {}  # frame, inner names, names to show
    for at in order(plan, fact):
        node = plan.nodes[at]
        if isinstance(node, Scan):
            inner = [f"n{at}_{i}" for i in range(len(node.columns))]
            df = table(node.table, list(node.columns)).select(*[F.col(c).alias(i) for c, i in zip(node.columns, inner)])
            made[at] = (df, inner, list(node.columns))
        elif isinstance(node, Filter):
            df, inner, shown = made[node.input]
            made[at] = (df.where(_expression(node.condition, inner)), inner, shown)
        elif isinstance(node, Project):
            df, inner, _ = made[node.input]
            new = [f"n{at}_{i}" for i in range(len(node.exprs))]
            made[at] = (df.select(*[_expression(e, inner).alias(i) for e, i in zip(node.exprs, new)]), new, list(node.names))
        elif isinstance(node, Join):
            if node.kind not in JOINS:
                raise ValueError(f"no join {node.kind!r}")
            (left, ln, ls), (right, rn, rs) = made[node.left], made[node.right]
            if set(ln) & set(rn) - {None}:  # one node on both sides
                new = [f"n{at}_{i}" for i in range(len(rn))]
                right = right.select(*[F.col(a).alias(b) for a, b in zip(rn, new) if a])
                rn = [b if a else None for a, b in zip(rn, new)]
            df = left.join(right, F.col(ln[node.left_key]) == F.col(rn[node.right_key]), JOINS[node.kind])
            if node.kind in ("semi", "anti"):  # positions stay, but nothing is there
                rn = rs = [None] * len(rn)
            made[at] = (df, ln + rn, ls + rs)
        elif isinstance(node, Aggregate):
            df, inner, shown = made[node.input]
            new = [inner[i] for i in node.group] + [f"n{at}_{i}" for i in range(len(node.measures))]
            found = [_measure(m, inner, node.zero_if_empty and not node.group).alias(f"n{at}_{i}") for i, m in enumerate(node.measures)]
            keys = list(dict.fromkeys(inner[i] for i in node.group))
            df = df.groupBy(*keys).agg(*found) if keys else df.agg(*found)
            made[at] = (df.select(*new), new, [shown[i] for i in node.group] + [m.name for m in node.measures])
        elif isinstance(node, Sort):
            df, inner, shown = made[node.input]
            keys = []
            for k in node.keys:
                c = _column(inner, k.index)
                keys.append((c.desc_nulls_last() if k.nulls_last else c.desc_nulls_first()) if k.descending else (c.asc_nulls_last() if k.nulls_last else c.asc_nulls_first()))
            made[at] = (df.orderBy(*keys), inner, shown)
        else:
            raise ValueError(f"no node {node!r}")
    df, inner, shown = made[len(plan.nodes) - 1]
    inner, shown = [i for i in inner if i], [s for s in shown if s]
    return df.toDF(*shown) if len(set(inner)) == len(inner) else df.select(*[F.col(i) for i in inner]).toDF(*shown)
