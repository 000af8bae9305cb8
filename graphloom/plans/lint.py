"""Advice on query shapes."""

from __future__ import annotations

from . import ast as A


def _comparisons(p):
    if isinstance(p, (A.And, A.Or)):
        yield from _comparisons(p.left)
        yield from _comparisons(p.right)
    elif isinstance(p, A.Not):
        yield from _comparisons(p.inner)
    elif isinstance(p, A.Compare) and p.op == "=":
        yield p


def lint_shape(query: A.Query) -> list[str]:
    """Node patterns of one label that only f(a.p) = f(b.p) connects: an equi-join on the expression
    here, a product of both in engines that don't see it."""
    label = {c.pattern.var: c.pattern.label for c in query.clauses if isinstance(c, A.Match) and isinstance(c.pattern, A.NodePattern) and c.pattern.var and c.pattern.label}
    out = []
    for c in _comparisons(query.where):
        a, b = c.left, c.right
        if isinstance(a, A.Call) and isinstance(b, A.Call) and a.name == b.name and len(a.args) == len(b.args) == 1 and isinstance(a.args[0], A.Prop) and isinstance(b.args[0], A.Prop):
            x, y = a.args[0].var, b.args[0].var
            if x != y and label.get(x) and label.get(x) == label.get(y):
                out.append(f"CartesianFunctionEquality: {a.name}({x}.{a.args[0].name}) = {b.name}({y}.{b.args[0].name}) over {label[x]}")
    return out
