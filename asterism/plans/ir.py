"""A relational plan as a flat list of nodes, with JSON in and out.

Columns are named by position in the node's input; a join's input is its left
columns followed by its right ones.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from ..functions.predicates import Range


@dataclass(frozen=True)
class Col:
    """The input's column at a position."""

    index: int


@dataclass(frozen=True)
class Lit:
    value: int


@dataclass(frozen=True)
class Call:
    """A comparison, AND, OR, or + - * /."""

    op: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Search:
    """Whether a value is in one of several ranges."""

    value: Expr
    ranges: tuple[Range, ...]


Expr = Col | Lit | Call | Search


@dataclass(frozen=True)
class Scan:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Filter:
    input: int
    condition: Expr


@dataclass(frozen=True)
class Project:
    input: int
    exprs: tuple[Expr, ...]
    names: tuple[str, ...]


@dataclass(frozen=True)
class Join:
    """left and right columns are positions in each side; kind: inner, left, right, full, semi or anti."""

    left: int
    right: int
    left_key: int
    right_key: int
    kind: str = "inner"


@dataclass(frozen=True)
class Measure:
    function: str
    arg: int | None = None
    name: str = "value"
    distinct: bool = False


@dataclass(frozen=True)
class Aggregate:
    input: int
    group: tuple[int, ...]
    measures: tuple[Measure, ...]
    zero_if_empty: bool = False


@dataclass(frozen=True)
class Key:
    index: int
    descending: bool = False
    nulls_last: bool = False


@dataclass(frozen=True)
class Sort:
    input: int
    keys: tuple[Key, ...]


Node = Scan | Filter | Project | Join | Aggregate | Sort
_NODES = {c.__name__.lower(): c for c in (Scan, Filter, Project, Join, Aggregate, Sort)}
_EXPRS = {c.__name__.lower(): c for c in (Col, Lit, Call, Search)}


@dataclass
class Plan:
    """nodes[i] refers to earlier nodes by their index; the last node is the result."""

    nodes: list[Node] = field(default_factory=list)

    def add(self, node: Node) -> int:
        for i in inputs(node):
            if not 0 <= i < len(self.nodes):
                raise ValueError(f"node {len(self.nodes)} reads node {i}, which is not before it")
        self.nodes.append(node)
        return len(self.nodes) - 1

    def to_json(self) -> str:
        return json.dumps([{"op": type(n).__name__.lower(), **{k: _out(getattr(n, k)) for k in n.__dataclass_fields__}} for n in self.nodes])

    @classmethod
    def from_json(cls, text: str) -> Plan:
        plan = cls()
        for item in json.loads(text):
            kind = _NODES.get(item.pop("op"))
            if kind is None:
                raise ValueError("unknown node")
            plan.add(kind(**{k: _in(k, v) for k, v in item.items()}))
        return plan


def inputs(node: Node) -> tuple[int, ...]:
    return (node.left, node.right) if isinstance(node, Join) else () if isinstance(node, Scan) else (node.input,)


def _out(value: Any) -> Any:
    if type(value).__name__.lower() in _EXPRS:
        return {"expr": type(value).__name__.lower(), **{k: _out(getattr(value, k)) for k in value.__dataclass_fields__}}
    if isinstance(value, (Range, Measure, Key)):
        return asdict(value)
    return [_out(v) for v in value] if isinstance(value, (tuple, list)) else value


def _in(name: str, value: Any) -> Any:
    if isinstance(value, dict):
        if "expr" in value:
            kind = _EXPRS[value["expr"]]
            return kind(**{k: _in(k, v) for k, v in value.items() if k != "expr"})
        return {"ranges": Range, "measures": Measure, "keys": Key}[name](**value)
    return tuple(_in(name, v) for v in value) if isinstance(value, list) else value
