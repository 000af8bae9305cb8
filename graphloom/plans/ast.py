"""The query tree that the text parser and the fluent builder both produce."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Prop:
    var: str
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Agg:
    """kind: count_star, count, count_distinct, collect, collect_distinct, size"""

    kind: str
    arg: Any = None


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class In:
    left: Any
    right: Any


@dataclass(frozen=True)
class Matches:
    left: Any
    pattern: Any


@dataclass(frozen=True)
class NotExists:
    query: "Query"


@dataclass(frozen=True)
class And:
    left: Any
    right: Any


@dataclass(frozen=True)
class Or:
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    inner: Any


@dataclass(frozen=True)
class NodePattern:
    var: str | None = None
    label: str | None = None
    props: tuple = ()


@dataclass(frozen=True)
class PathPattern:
    """direction: out, in or both; hops: None for one hop, else (least, most)."""

    source: NodePattern
    target: NodePattern
    direction: str = "out"
    edge_var: str | None = None
    edge_label: str | None = None
    hops: tuple | None = None


@dataclass(frozen=True)
class Match:
    pattern: Any
    optional: bool = False


@dataclass(frozen=True)
class Unwind:
    param: str
    var: str


@dataclass(frozen=True)
class Item:
    value: Any
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or default_name(self.value)


@dataclass(frozen=True)
class With:
    items: tuple
    where: Any = None


@dataclass(frozen=True)
class Return:
    items: tuple
    distinct: bool = False
    order: tuple = ()  # (column name, ascending)
    limit: int | None = None


@dataclass(frozen=True)
class Query:
    clauses: tuple = ()
    where: Any = None
    with_: With | None = None
    return_: Return | None = None
    params: dict = field(default_factory=dict, hash=False, compare=True)


def default_name(e: Any) -> str:
    """The column name of an expression without an alias."""
    if isinstance(e, Agg):
        return "count" if e.kind == "count_star" else e.kind
    if isinstance(e, Prop):
        return f"{e.var}.{e.name}"
    if isinstance(e, Var):
        return e.name
    if isinstance(e, Param):
        return f"${e.name}"
    if isinstance(e, ListOf):
        return "list"
    return e.name if isinstance(e, Call) else "literal"
