"""A fluent way to the same query tree."""

from __future__ import annotations

from typing import Any

from . import ast as A


def _expr(e: Any) -> Any:
    """'v.p' and ast nodes as they are; other values are literals."""
    if isinstance(e, str) and e.count(".") == 1 and all(p.isidentifier() for p in e.split(".")):
        return A.Prop(*e.split("."))
    return e if type(e).__module__ == A.__name__ else A.Lit(e)


class QueryBuilder:
    def __init__(self) -> None:
        self._clauses: list = []
        self._where: Any = None
        self._with: A.With | None = None
        self._items: tuple = ()
        self._order: list = []
        self._distinct, self._limit = False, None
        self._params: dict = {}
        self._optional = False

    def _add(self, pattern: Any) -> "QueryBuilder":
        self._clauses.append(A.Match(pattern, self._optional))
        self._optional = False
        return self

    def optional(self) -> "QueryBuilder":
        """The next pattern is optional."""
        self._optional = True
        return self

    def match_node(self, var: str | None, label: str | None = None) -> "QueryBuilder":
        return self._add(A.NodePattern(var, label))

    def match_node_with_props(self, var: str | None, label: str | None, props: dict) -> "QueryBuilder":
        return self._add(A.NodePattern(var, label, tuple((k, A.Lit(v)) for k, v in props.items())))

    def match_path(self, source: A.NodePattern, edge_label: str | None, target: A.NodePattern, direction: str = "out", edge_var: str | None = None) -> "QueryBuilder":
        return self._add(A.PathPattern(source, target, direction, edge_var, edge_label))

    def match_var_path(self, source: A.NodePattern, edge_label: str | None, target: A.NodePattern, least: int, most: int, direction: str = "out") -> "QueryBuilder":
        return self._add(A.PathPattern(source, target, direction, None, edge_label, (least, most)))

    def unwind(self, param: str, var: str) -> "QueryBuilder":
        self._clauses.append(A.Unwind(param, var))
        return self

    def where(self, predicate: Any) -> "QueryBuilder":
        self._where = predicate if self._where is None else A.And(self._where, predicate)
        return self

    def where_eq(self, left: Any, right: Any) -> "QueryBuilder":
        return self.where(A.Compare("=", _expr(left), _expr(right)))

    def where_ne(self, left: Any, right: Any) -> "QueryBuilder":
        return self.where(A.Compare("<>", _expr(left), _expr(right)))

    def where_lt(self, left: Any, right: Any) -> "QueryBuilder":
        return self.where(A.Compare("<", _expr(left), _expr(right)))

    def where_gt(self, left: Any, right: Any) -> "QueryBuilder":
        return self.where(A.Compare(">", _expr(left), _expr(right)))

    def where_in(self, left: Any, right: Any) -> "QueryBuilder":
        right = A.ListOf(tuple(map(_expr, right))) if isinstance(right, (list, tuple)) else _expr(right)
        return self.where(A.In(_expr(left), right))

    def where_regex(self, left: Any, pattern: Any) -> "QueryBuilder":
        return self.where(A.Matches(_expr(left), A.Lit(pattern) if isinstance(pattern, str) else pattern))

    def with_(self, *items: A.Item) -> "QueryBuilder":
        self._with = A.With(tuple(items), self._with.where if self._with else None)
        return self

    def with_where(self, predicate: Any) -> "QueryBuilder":
        self._with = A.With(self._with.items if self._with else (), predicate)
        return self

    def return_items(self, *items: Any) -> "QueryBuilder":
        self._items = tuple(i if isinstance(i, A.Item) else A.Item(_expr(i)) for i in items)
        return self

    def return_count_star(self, alias: str | None = None) -> "QueryBuilder":
        self._items = (A.Item(A.Agg("count_star"), alias),)
        return self

    def distinct(self) -> "QueryBuilder":
        self._distinct = True
        return self

    def order_by(self, column: str, ascending: bool = True) -> "QueryBuilder":
        self._order.append((column, ascending))
        return self

    def limit(self, n: int) -> "QueryBuilder":
        self._limit = n
        return self

    def param(self, name: str, value: Any) -> "QueryBuilder":
        self._params[name] = value
        return self

    def param_list(self, name: str, values: list) -> "QueryBuilder":
        self._params[name] = list(values)
        return self

    def build(self) -> A.Query:
        return A.Query(tuple(self._clauses), self._where, self._with, A.Return(self._items, self._distinct, tuple(self._order), self._limit), dict(self._params))
