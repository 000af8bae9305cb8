"""Query tree -> one lazy DataFrame.

A frame holds a column group for each variable: `v__id`, `v__label` and `v__p_<name>` of a node,
`v__src`, `v__dst`, `v__label` and properties of an edge, `v` of a scalar or list.  Only properties
that the query mentions are read.  Hops are equi-joins, several MATCH clauses a product that Catalyst
turns into equi-joins through the WHERE clause, reachability a chain of distinct frontier joins.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.scalar import FUNCTIONS, PREPARED, matches, prepared
from ..sources.graph import Graph
from . import ast as A
from .joins import placed, repeated, spread
from .tables import stored

#: Comparisons with their sides exchanged.
_TURNED = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
#: Hops beyond which a variable-length pattern isn't followed, unless its least number is larger.
MOST_HOPS = 5


@dataclass(frozen=True)
class Binding:
    """kind: node, edge or value; kinds: of the properties; val: of a value."""

    kind: str
    kinds: dict = field(default_factory=dict)
    nullable: bool = False
    val: V.Val | None = None


@dataclass
class Warning_:
    kind: str
    message: str
    suggestion: str | None = None


def _mentioned(node: Any, out: dict[str, set[str]]) -> None:
    if isinstance(node, A.Prop):
        out.setdefault(node.var, set()).add(node.name)
    elif isinstance(node, A.NodePattern):
        if node.var:
            out.setdefault(node.var, set()).update(k for k, _ in node.props)
    elif isinstance(node, (tuple, list)):
        for x in node:
            _mentioned(x, out)
        return
    if hasattr(node, "__dataclass_fields__"):
        for name in node.__dataclass_fields__:
            if name != "params":
                _mentioned(getattr(node, name), out)


def _vars(e: Any) -> set[str]:
    """The variables of an expression; "" stands for a query within it."""
    if isinstance(e, A.NotExists):
        return {""}
    if isinstance(e, (A.Prop, A.Var)):
        return {e.var if isinstance(e, A.Prop) else e.name}
    if isinstance(e, (tuple, list)):
        return set().union(*map(_vars, e))
    return set().union(*(_vars(getattr(e, f)) for f in e.__dataclass_fields__)) if hasattr(e, "__dataclass_fields__") else set()


def _parts(e: Any):
    """An expression and all within it, queries excepted."""
    if isinstance(e, (tuple, list)):
        for x in e:
            yield from _parts(x)
    elif hasattr(e, "__dataclass_fields__") and not isinstance(e, A.NotExists):
        yield e
        for f in e.__dataclass_fields__:
            yield from _parts(getattr(e, f))


def _substituted(e: Any, by: dict[str, Any]) -> Any:
    """An expression in which variables stand for others."""
    if isinstance(e, (A.Var, A.Prop)):
        own = by.get(e.name if isinstance(e, A.Var) else e.var, e)
        return own if isinstance(e, A.Var) or own is e else A.Lit(None)
    if isinstance(e, tuple):
        return tuple(_substituted(x, by) for x in e)
    return replace(e, **{f.name: _substituted(getattr(e, f.name), by) for f in fields(e)}) if hasattr(e, "__dataclass_fields__") else e


def _without(e: Any, known: set) -> Any:
    """An expression with NULL in place of known ones."""
    if isinstance(e, tuple):
        return tuple(_without(x, known) for x in e)
    if isinstance(e, A.Call) and e in known:
        return A.Lit(None)
    return replace(e, **{f.name: _without(getattr(e, f.name), known) for f in fields(e)}) if hasattr(e, "__dataclass_fields__") and not isinstance(e, A.NotExists) else e


def _conjuncts(p: Any) -> list:
    return [*_conjuncts(p.left), *_conjuncts(p.right)] if isinstance(p, A.And) else [p]


class Compiler:
    def __init__(self, graph: Graph, query: A.Query, params: dict | None = None, most_hops: int = MOST_HOPS):
        self.graph, self.query, self.most_hops = graph, query, most_hops
        self.params = {**query.params, **(params or {})}
        self.warnings: list[Warning_] = []
        self.props: dict[str, set[str]] = {}
        _mentioned(query, self.props)
        self.env: dict[str, Binding] = {}
        self.frame: DataFrame | None = None
        self.fresh = 0
        self.hoists = self._hoists()
        self.made: dict[Any, V.Val] = {}  # what has a column of its own
        self.many = False  # the frame's rows stand for `_n` rows each
        self.walked: DataFrame | None = None  # (start, node) of the walk at hand, where it is known
        self.placed = False  # the frame's partitions are in the order asked for

    # --- frames
    def _col(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def _one(self) -> DataFrame:
        return self.graph.spark.range(1).select()

    def _joined(self, other: DataFrame, on: Column | None, how: str = "inner") -> DataFrame:
        if self.frame is None:
            if how == "inner" and on is None:
                return other
            self.frame = self._one()
        if on is None:
            return self.frame.crossJoin(other) if how == "inner" else self.frame.join(other, F.lit(True), how)
        return self.frame.join(other, on, how)

    def _warn(self, kind: str, message: str, suggestion: str | None = None) -> None:
        if not any(w.kind == kind and w.message == message for w in self.warnings):
            self.warnings.append(Warning_(kind, message, suggestion))

    def _known(self, of: str, label: str | None, warn: bool = True) -> bool:
        have = self.graph.nodes if of == "node" else self.graph.edges
        if label is None or label in have:
            return True
        if warn:
            near = difflib.get_close_matches(label, have, 1, 0.6)
            self._warn("UnknownLabel" if of == "node" else "UnknownEdgeLabel", f"unknown {of} label {label!r}", f"did you mean {near[0]!r}?" if near else None)
        return False

    def _name(self, var: str | None) -> str:
        self.fresh += 1
        return var or f"_{self.fresh}"

    def _entity(self, of: str, label: str | None, name: str, props: set[str]) -> tuple[DataFrame, Binding]:
        """A table with its columns named for a variable, and the variable's binding."""
        kinds = {p: self.graph.properties(of, label).get(p, "missing") for p in props}
        table = self.graph.table(of, label, [p for p, k in kinds.items() if k != "missing"])
        cols = [self._col(c).alias(f"{name}__{c}") for c in table.columns]
        return table.select(*cols), Binding(of, kinds)

    def _hoists(self) -> dict[str, list]:
        """By variable, what a query asks of that node alone: (key, how, expression)."""
        q = self.query
        if any(isinstance(c, A.Unwind) or c.optional for c in q.clauses):
            return {}  # variables may be bound anew there
        out: dict[str, dict] = {}
        for e in _parts((q.where, q.with_ and q.with_.items, q.return_ and q.return_.items)):
            if isinstance(e, A.In) and isinstance(e.right, A.Param) and isinstance(self.params.get(e.right.name), DataFrame):
                found = [(e, "listed", e.left)]
            elif isinstance(e, A.Call) and len(_vars(e)) == 1:
                found = [(e, "call", e)]
            elif isinstance(e, A.Call) and e.name in PREPARED and len(e.args) == len(PREPARED[e.name]):
                found = [((kind, a), kind, a) for kind, a in zip(PREPARED[e.name], e.args) if kind]
            else:
                continue
            for key, how, own in found:
                if len(v := _vars(own)) == 1:
                    out.setdefault(*v, {})[key] = (key, how, own)
        return {v: list(own.values()) for v, own in out.items()}

    def _hoisted(self, var: str | None, table: DataFrame, binding: Binding) -> DataFrame:
        """A node's table with the columns that the query's expressions on it alone have."""
        if var not in self.hoists:
            return table
        env, self.env = self.env, {var: binding}
        for i, (key, how, e) in enumerate(self.hoists[var]):
            name, v = f"{var}__h{i}", self.value(e)
            if how == "listed":
                values = self.params[key.right.name]
                field_ = values.schema.fields[0]
                if V.kind_of(field_.dataType) != v.kind:
                    table = table.withColumn(name, F.lit(False))
                else:
                    table = table.withColumn("_at", v.col)
                    table = table.join(values.select(F.col(f"`{field_.name}`").alias("_at")).distinct().withColumn(name, F.lit(True)), "_at", "left").drop("_at")
                own = V.Val("bool", self._col(name))
            else:
                made = v if how == "call" else prepared(how, v)
                if made.kind in ("missing", "null", "list"):
                    continue
                table, own = table.withColumn(name, made.col), replace(made, col=self._col(name), constant=None)
            self.made[key] = own
        self.env = env
        return table

    def _inline(self, name: str, binding: Binding, props: tuple) -> Column | None:
        test = None
        for key, lit in props:
            own = V.same(self._prop(name, binding, key), V.literal(lit.value))
            test = own if test is None else test & own
        return test

    def _prop(self, name: str, b: Binding, key: str) -> V.Val:
        if b.kind == "edge" and key in ("label", "src", "dst"):
            return V.Val("str", self._col(f"{name}__{key}"))
        kind = b.kinds.get(key, "missing")
        return V.missing() if kind == "missing" else V.Val(kind, self._col(f"{name}__p_{key}"))

    # --- patterns
    def _node(self, p: A.NodePattern, optional: bool) -> None:
        bound = self.env.get(p.var) if p.var else None
        if bound is not None:
            if not optional:  # an optional one that fails leaves its row as it is
                test = F.lit(False) if bound.kind != "node" else self._col(f"{p.var}__id").isNotNull()
                if p.label is not None:
                    test = test & (self._col(f"{p.var}__label") == p.label) if bound.kind == "node" else test
                inline = self._inline(p.var, bound, p.props) if bound.kind == "node" else None
                self.frame = self.frame.where(test if inline is None else test & inline)
            return
        self._known("node", p.label)
        name = self._name(p.var)
        table, binding = self._entity("node", p.label, name, self.props.get(p.var, set()) | {k for k, _ in p.props})
        if (inline := self._inline(name, binding, p.props)) is not None:
            table = table.where(inline)
        table = self._hoisted(p.var, table, binding)
        self.frame = self._joined(table, None, "left" if optional else "inner")
        if p.var:
            self.env[p.var] = replace(binding, nullable=optional)

    def _path(self, p: A.PathPattern, optional: bool) -> None:
        source, target = (p.source, p.target) if p.direction != "in" else (p.target, p.source)
        if not self._known("edge", p.edge_label):
            self._nothing(p, optional)
            return
        # the written source is the end that is enumerated or pinned without its label
        written = p.source.var
        bound = self.env.get(written) if written else None
        if bound is not None and not optional and (bound.kind == "value" or bound.nullable):
            if bound.kind == "value":  # a scalar is enumerated anew
                self.frame = self.frame.drop(written)
                del self.env[written]
            else:
                self._path_of_nullable(p, written, bound)
                return
        edge_props = self.props.get(p.edge_var, set()) if p.edge_var else set()
        name = self._name(None)
        if p.hops is None:
            edges, edge_binding = self._entity("edge", p.edge_label, name, edge_props)
        else:
            edges, edge_binding = self._reach(p, name), None
        # edges run from `source` to `target`; a walk that may go both ways has both directions
        if p.direction == "both" and p.hops is None:
            src, dst = self._col(f"{name}__src"), self._col(f"{name}__dst")
            rest = [self._col(c) for c in edges.columns if c not in (f"{name}__src", f"{name}__dst")]
            ends = [src.alias(f"{name}__rs"), dst.alias(f"{name}__rd")]  # as they are, whatever the direction walked
            turned = edges.select(dst.alias(f"{name}__src"), src.alias(f"{name}__dst"), *rest, *ends)
            edges = edges.select(src, dst, *rest, *ends)
            edges = edges.unionByName(turned)
        frame_on: list[Column] = []
        new: dict[str, Binding] = {}
        if p.source.var and p.source.var == p.target.var and p.source.var not in self.env:
            edges = edges.where(self._col(f"{name}__src") == self._col(f"{name}__dst"))
        for end, column in ((source, f"{name}__src"), (target, f"{name}__dst")):
            own = self.env.get(end.var) if end.var else None
            is_written_source = end is p.source
            if own is not None:
                if own.kind != "node":
                    frame_on.append(F.lit(False))
                    continue
                frame_on.append(self._col(column) == self._col(f"{end.var}__id"))
                if end.label is not None and not is_written_source:
                    frame_on.append(self._col(f"{end.var}__label") == end.label)
                if (inline := self._inline(end.var, own, end.props)) is not None:
                    frame_on.append(inline)
                continue
            if end.var and end.var in new:
                continue
            if is_written_source:
                self._known("node", end.label)
            var = self._name(end.var)
            wanted = self.props.get(end.var, set()) | {k for k, _ in end.props}
            sure = self._sure(p.edge_label, end is source, end.label) if p.direction != "both" else None
            if sure and not wanted & set(self.graph.properties("node", sure)):
                # the edges' schema says what stands at this end, and nothing of it is read
                edges = edges.withColumn(f"{var}__id", self._col(column)).withColumn(f"{var}__label", F.lit(sure))
                if (inline := self._inline(var, Binding("node", {}), end.props)) is not None:
                    edges = edges.where(inline)
                if end.var:
                    new[end.var] = Binding("node", {k: "missing" for k in wanted}, optional)
                continue
            table, binding = self._entity("node", end.label, var, wanted)
            if (inline := self._inline(var, binding, end.props)) is not None:
                table = table.where(inline)
            table = self._hoisted(end.var, table, binding)
            if not end.var:
                table = table.select(f"{var}__id")
            edges = edges.join(table, self._col(column) == self._col(f"{var}__id"))
            if end.var:
                new[end.var] = replace(binding, nullable=optional)
        on = None
        for c in frame_on:
            on = c if on is None else on & c
        if p.edge_var and p.hops is None:
            if p.edge_var in self.env and self.frame is not None:
                self.frame = self.frame.drop(*[c for c in self.frame.columns if c == p.edge_var or c.startswith(f"{p.edge_var}__")])
            own = [c for c in edges.columns if c.startswith(f"{name}__")]
            if p.direction == "both":
                edges = edges.withColumns({f"{p.edge_var}__src": self._col(f"{name}__rs"), f"{p.edge_var}__dst": self._col(f"{name}__rd")})
                own = [c for c in own if c not in (f"{name}__rs", f"{name}__rd", f"{name}__src", f"{name}__dst")]
            edges = edges.withColumns({p.edge_var + c[len(name) :]: self._col(c) for c in own})
            new[p.edge_var] = replace(edge_binding, nullable=optional)
        self.frame = self._joined(edges, on, "left" if optional else "inner")
        self.frame = self.frame.drop(*[c for c in self.frame.columns if c.startswith(f"{name}__")])
        self.env.update(new)

    def _sure(self, edge_label: str | None, at_source: bool, label: str | None) -> str | None:
        """The one label that the nodes at an end of these edges have, where the graph vouches for it
        and the pattern asks for no other."""
        own = (self.graph.ends.get(edge_label) or (None, None))[0 if at_source else 1]
        return own if own is not None and label in (None, own) else None

    def _path_of_nullable(self, p: A.PathPattern, var: str, bound: Binding) -> None:
        """Rows in which the source is null enumerate it anew; the others are pinned."""
        frame, env = self.frame, dict(self.env)
        self.frame, self.env = frame.where(self._col(f"{var}__id").isNotNull()), {**env, var: replace(bound, nullable=False)}
        self._path(p, False)
        pinned, pinned_env = self.frame, self.env
        own = [c for c in frame.columns if c.startswith(f"{var}__")]
        self.frame, self.env = frame.where(self._col(f"{var}__id").isNull()).drop(*own), {k: b for k, b in env.items() if k != var}
        self._path(p, False)
        kinds = self.env[var].kinds
        columns = []
        for c in pinned.columns:
            key = c[len(var) + 4 :] if c.startswith(f"{var}__p_") else None
            if c not in self.frame.columns or (key is not None and kinds.get(key) != bound.kinds.get(key)):
                columns.append(F.lit(None).cast(pinned.schema[c].dataType).alias(c))
            else:
                columns.append(self._col(c))
        self.frame = pinned.unionByName(self.frame.select(*columns))
        self.env = {**pinned_env, var: replace(bound, nullable=False)}

    def _nothing(self, p: A.PathPattern, optional: bool) -> None:
        for end in (p.source, p.target):
            if end.var and end.var not in self.env:
                table, binding = self._entity("node", end.label, end.var, self.props.get(end.var, set()))
                self.frame = self._joined(table.where(F.lit(False)), None, "left" if optional else "inner")
                self.env[end.var] = replace(binding, nullable=True)
        if p.edge_var and p.hops is None and p.edge_var not in self.env:
            self.env[p.edge_var] = Binding("edge", {}, True)
            none = self._one().select(*[F.lit(None).cast("string").alias(f"{p.edge_var}__{c}") for c in ("src", "dst", "label")])
            self.frame = self._joined(none, None)
        if not optional:
            self.frame = (self.frame if self.frame is not None else self._one()).where(F.lit(False))

    def _reach(self, p: A.PathPattern, name: str) -> DataFrame:
        """(src, dst) with the least number of hops between them in range; never src itself.  Each
        round joins the newest nodes alone and keeps the others, one aggregate a round, so walks aren't
        enumerated and no round is derived twice."""
        src, dst = ("start", "node") if p.direction != "in" else ("node", "start")
        if self.walked is not None:
            return self.walked.select(F.col(src).alias(f"{name}__src"), F.col(dst).alias(f"{name}__dst"))
        least, most = self._hops(p)
        edges = self.graph.table("edge", p.edge_label, []).select("src", "dst")
        if p.direction == "both":
            edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        edges = edges.distinct()
        # walk from the written source: edges run source -> target after the swap for `in`
        end = p.source
        var = end.var
        start = None
        if var in self.env and self.env[var].kind == "node" and self.frame is not None:
            start = self.frame.select(self._col(f"{var}__id").alias("start")).distinct()
        elif end.label is not None and (p.direction == "both" or not self._sure(p.edge_label, p.direction == "out", end.label)):
            start = self.graph.table("node", end.label, []).select(F.col("id").alias("start"))
        a, b = ("src", "dst") if p.direction != "in" else ("dst", "src")
        hop = edges.select(F.col(a).alias("at"), F.col(b).alias("to"))
        rows = hop.select(F.col("at").alias("start"), F.col("to").alias("node")).where("start <> node")
        if start is not None:
            rows = rows.join(start, "start", "left_semi")
        rows = rows.withColumn("d", F.lit(1))
        for d in range(1, most):
            # nodes found earlier stay by a key that no edge has, spread by their start
            key = F.when(F.col("d") == d, F.col("node")).otherwise(F.concat(F.lit("\0"), "start"))
            ends = F.array(F.struct("node", "d"), F.struct(F.col("to").alias("node"), F.lit(d + 1).alias("d")))
            rows = rows.withColumn("_key", key).join(hop, F.col("_key") == F.col("at"), "left").select("start", F.explode(ends).alias("_e")).select("start", "_e.*")
            rows = rows.where("start <> node").groupBy("start", "node").agg(F.min("d").alias("d"))
        pairs = rows.where(F.col("d") >= max(least, 1))
        return pairs.select(F.col(src).alias(f"{name}__src"), F.col(dst).alias(f"{name}__dst"))

    def _hops(self, p: A.PathPattern) -> tuple[int, int]:
        least, most = p.hops
        return least, min(max(most, least), max(self.most_hops, least))

    def _unwind(self, clause: A.Unwind) -> bool:
        values = self.params.get(clause.param)
        if not isinstance(values, (list, tuple)):
            self._warn("EmptyResult", f"UNWIND ${clause.param}: not a list")
            values, bad = [], True
        else:
            bad = False
        vals = [V.literal(v) for v in values]
        kinds = {v.kind for v in vals}
        kind = kinds.pop() if len(kinds) == 1 and "null" not in kinds else "tagged" if vals else "str"
        columns = [V.tagged(v) if kind == "tagged" else v.col for v in vals]
        table = self._one().select(F.explode(F.array(*columns)).alias(clause.var)) if vals else self._one().select(F.lit("").alias(clause.var)).where(F.lit(False))
        self.frame = self._joined(table, None)
        self.env[clause.var] = Binding("value", val=V.Val(kind, self._col(clause.var)))
        return not bad

    def patterns(self) -> None:
        for clause in self.query.clauses:
            if isinstance(clause, A.Unwind):
                self._unwind(clause)
            elif isinstance(clause.pattern, A.NodePattern):
                self._node(clause.pattern, clause.optional)
            else:
                self._path(clause.pattern, clause.optional)

    # --- expressions
    def value(self, e: Any) -> V.Val:
        if isinstance(e, A.Lit):
            return V.literal(e.value)
        if isinstance(e, A.Param):
            v = self.params.get(e.name, self)
            return V.missing() if v is self or isinstance(v, (list, tuple, DataFrame)) else V.literal(v)
        if isinstance(e, A.Prop):
            b = self.env.get(e.var)
            return V.missing() if b is None or b.kind == "value" else self._prop(e.var, b, e.name)
        if isinstance(e, A.Var):
            b = self.env.get(e.name)
            if b is None:
                return V.missing()
            return b.val if b.kind == "value" else V.Val("str", self._col(f"{e.name}__{'id' if b.kind == 'node' else 'label'}"))
        if isinstance(e, A.Call) and e in self.made:
            return self.made[e]
        if isinstance(e, A.Call) and e.name in FUNCTIONS:
            n, build = FUNCTIONS[e.name]
            forms = PREPARED.get(e.name, ())
            args = [self.made.get((forms[i] if i < len(forms) else None, a)) or self.value(a) for i, a in enumerate(e.args)]
            return build(*args) if len(args) == n else V.missing()
        return V.missing()

    def predicate(self, p: Any, top: bool = True) -> Column:
        """Two-valued: below OR and NOT every atom is made non-null, at the top a NULL drops the row
        just as false does, and the bare comparison can reach the files."""
        if isinstance(p, A.And):
            return self.predicate(p.left, top) & self.predicate(p.right, top)
        if isinstance(p, A.Or):
            return self.predicate(p.left, False) | self.predicate(p.right, False)
        if isinstance(p, A.Not):
            return ~self.predicate(p.inner, False)
        if isinstance(p, A.NotExists):
            return self._not_exists(p.query)
        if isinstance(p, A.Compare):
            out = V.compare(p.op, self.value(p.left), self.value(p.right))
        elif isinstance(p, A.Matches):
            out = matches(self.value(p.left), self.value(p.pattern))
        else:
            out = self._in(p)
        return out if top else F.coalesce(out, F.lit(False))

    def _in(self, p: A.In) -> Column:
        if p in self.made:
            return self.made[p].col
        left = self.value(p.left)
        if isinstance(p.right, A.Param) and isinstance(values := self.params.get(p.right.name), DataFrame):
            if left.kind != V.kind_of(values.schema.fields[0].dataType):
                return F.lit(False)
            self.fresh += 1
            at, flag = f"_at{self.fresh}", f"_listed{self.fresh}"
            table = values.toDF(at).distinct().withColumn(flag, F.lit(True))
            self.frame = self.frame.join(table, left.col == F.col(at), "left").drop(at)
            return self._col(flag)
        if isinstance(p.right, A.ListOf):
            items = [self.value(x) for x in p.right.items]
        elif isinstance(p.right, A.Param):
            v = self.params.get(p.right.name, self)
            items = [] if v is self else [V.literal(x) for x in (v if isinstance(v, (list, tuple)) else [v])]
        else:
            item = self.value(p.right)
            items = [] if item.kind == "list" else [item]
        if left.kind in V.NATIVE and items and all(i.constant for i in items):
            same_kind = [i.constant[0] for i in items if i.kind == left.kind]
            return left.col.isin(same_kind) if same_kind else F.lit(False)
        out = F.lit(False)
        for i in items:
            out = out | F.coalesce(V.same(left, i), F.lit(False))
        return out

    def _not_exists(self, query: A.Query) -> Column:
        """One boolean for the whole query: the inner query sees parameters, no variables."""
        inner = Compiler(self.graph, query, self.params, self.most_hops)
        inner.patterns()
        rows = inner.frame
        if query.where is not None:
            rows = inner._filtered(rows, query.where)
        self.fresh += 1
        flag = f"_absent{self.fresh}"
        one = rows.limit(1).agg((F.count(F.lit(1)) == 0).alias(flag))
        self.frame = (self.frame if self.frame is not None else self._one()).crossJoin(F.broadcast(one))
        return self._col(flag)

    # --- two nodes that WHERE ties
    def _pair(self) -> DataFrame | None:
        """The rows of two nodes in MATCH that WHERE ties by equal values, WHERE applied; None for other queries."""
        q = self.query
        nodes = [c.pattern for c in q.clauses if isinstance(c, A.Match) and not c.optional and isinstance(c.pattern, A.NodePattern)]
        if len(q.clauses) != 2 or len(nodes) != 2 or q.where is None or None in (x := nodes[0].var, y := nodes[1].var) or x == y:
            return None
        own, ties = {x: [], y: []}, []
        for c in _conjuncts(q.where):
            if not (v := _vars(c)) <= {x, y} or any(isinstance(e, A.In) and (e not in [k for h in self.hoists.values() for k, _, _ in h]) and isinstance(e.right, A.Param) and isinstance(self.params.get(e.right.name), DataFrame) for e in _parts(c)):
                return None
            (ties if len(v) == 2 else own[next(iter(v), x)]).append(c)
        # (operator, value of x, value of y)
        sides = [(t.op, t.left, t.right) if _vars(t.left) == {x} else (_TURNED[t.op], t.right, t.left) for t in ties if isinstance(t, A.Compare) and len(_vars(t.left)) == len(_vars(t.right)) == 1]
        if not any(op == "=" for op, _, _ in sides):
            return None
        tables = {}
        for p in nodes:
            self._known("node", p.label)
            table, self.env[p.var] = self._entity("node", p.label, p.var, self.props.get(p.var, set()) | {k for k, _ in p.props})
            if (inline := self._inline(p.var, self.env[p.var], p.props)) is not None:
                table = table.where(inline)
            table = self._hoisted(p.var, table, self.env[p.var])
            for c in own[p.var]:
                table = table.where(self.predicate(c))
            tables[p.var] = table
        native = lambda a, b: a.kind == b.kind and a.kind in V.NATIVE
        keys, apart, above, rest = [], [], [], []
        for t in ties:
            if isinstance(t, A.Compare) and len(_vars(t.left)) == len(_vars(t.right)) == 1:
                op, e, f = (t.op, t.left, t.right) if _vars(t.left) == {x} else (_TURNED[t.op], t.right, t.left)
                a, b = self.value(e), self.value(f)
                if native(a, b) and op in ("=", "<>", "<", ">"):
                    {"=": keys, "<>": apart}.get(op, above).append((t, op, a, b))
                    continue
            divergent = t.left if isinstance(t, A.Compare) and t.op == "=" and t.right == A.Lit(True) else None
            if isinstance(divergent, A.Call) and divergent.name == "signature_divergent" and len(divergent.args) == 2 and all(("squeezed", e) in self.made for e in divergent.args) and len(set(map(frozenset, map(_vars, divergent.args)))) == 2:
                a, b = (self.made["squeezed", e] for e in sorted(divergent.args, key=lambda e: _vars(e) != {x}))
                apart.append((t, "<>", a, b))
                # texts that differ when squeezed do so as they are
                apart = [p for p in apart if not (isinstance(p[0], A.Compare) and {p[0].left, p[0].right} == set(divergent.args))]
                continue
            rest.append(t)
        if not keys:
            self.env, self.made = {}, {}
            return None
        named = [f"_k{i}" for i in range(len(keys))]
        for v, at in ((x, 2), (y, 3)):
            tables[v] = tables[v].withColumns({n: k[at].col for n, k in zip(named, keys)}).dropna(subset=named)
        shown = _vars(q.return_.items)
        if q.with_ is None and not rest and len(above) < 2 and len(apart) < 4 and len(shown) == 1 and q.return_.limit is None and not any(isinstance(e, A.Agg) for e in _parts(q.return_.items)):
            at = 2 if x in shown else 3
            return self._counted(tables[x if at == 2 else y], tables[y if at == 2 else x], named, [(k[at].col, k[5 - at].col) for k in apart], [(k[at].col, k[5 - at].col, (k[1] == "<") == (at == 2)) for k in above])
        return self._paired(tables[x], tables[y], {x}, {y}, named, [*rest, *(k[0] for k in (*apart, *above))])

    def _paired(self, left: DataFrame, right: DataFrame, x: set[str], y: set[str], keys: list[str], tests: list) -> DataFrame:
        """All pairs of equal keys that pass tests; x, y: the variables of either side.  Functions of both nodes are computed once for each two
        of their arguments' values, and values tested then, before pairs are made."""
        q = self.query
        calls = {e for e in _parts((q.where, q.with_ and q.with_.items, q.return_.items)) if isinstance(e, A.Call) and e.name in PREPARED and len(e.args) == len(PREPARED[e.name]) and _vars(e) & x and _vars(e) & y and all(len(_vars(a)) == 1 and self.value(a).kind == "str" for a in e.args)}
        if calls:
            args = sorted({a for c in calls for a in c.args}, key=str)
            at = {a: f"_c{i}" for i, a in enumerate(args)}
            classes = []
            for v, group in ((x, "_cx"), (y, "_cy")):
                own = [a for a in args if _vars(a) <= v]
                table = (left if v is x else right).withColumn(group, F.struct(*[self.value(a).col.alias(at[a]) for a in own]))
                forms = {(k, a) for c in calls for k, a in zip(PREPARED[c.name], c.args) if k and a in own}
                distinct = table.select(*keys, group).distinct()
                classes.append(distinct.select(*keys, group, *[F.col(group)[at[a]].alias(at[a]) for a in own], *[prepared(k, V.Val("str", F.col(group)[at[a]])).col.alias(f"{at[a]}_{k}") for k, a in sorted(forms, key=str)]))
                left, right = (table, right) if v is x else (left, table)
            found = {c: FUNCTIONS[c.name][1](*[V.Val(k or "str", F.col(f"{at[a]}_{k}" if k else at[a])) for k, a in zip(PREPARED[c.name], c.args)]) for c in sorted(calls, key=str)}
            pairs = spread(classes[0], classes[1], keys, ["_cx"], keep=True).select(*keys, "_cx", "_cy", *[v.col.alias(f"_f{i}") for i, v in enumerate(found.values())])
            left = left.join(pairs, [*keys, "_cx"]).drop("_cx")
            keys = [*keys, "_cy"]
            self.made |= {c: V.Val(v.kind, F.col(f"_f{i}")) for i, (c, v) in enumerate(found.items())}
        known = lambda e: _vars(_without(e, calls)) <= x
        by = {i.name: i.value for i in q.with_.items} if q.with_ is not None else {}
        simple = not any(isinstance(e, A.Agg) for e in _parts((q.with_ and q.with_.items, q.return_.items)))
        # what follows WITH and is known by now needn't wait for it
        early = [_substituted(c, by) for c in _conjuncts(q.with_.where)] if simple and q.with_ is not None and q.with_.where is not None else []
        on = None
        for t in [*tests, *early]:
            if known(t):
                left = left.where(self.predicate(t))
            elif t not in early:
                on = self.predicate(t) if on is None else on & self.predicate(t)
        order = []
        shown = {i.name: _substituted(i.value, by) for i in q.return_.items}
        for name, up in q.return_.order if simple and not q.return_.distinct and q.return_.limit is None else ():
            v = self.value(shown[name]) if name in shown and known(shown[name]) else V.missing()
            if v.kind not in V.NATIVE:
                break
            order.append(v.col.asc_nulls_first() if up else v.col.desc_nulls_last())
        if order:
            self.placed = True
            return placed(left, right, keys, order, on)
        return spread(left, right, keys, [f"`{c}`" for c in left.columns if c.endswith("__id")], on)

    # --- two walks from one node
    def _star(self) -> DataFrame | None:
        """The rows of patterns in which two walks of many hops leave one node, WHERE applied; None for other
        queries.  Walks are found once, and what hangs on the second is put together before it meets the first."""
        q = self.query
        if q.where is None or any(isinstance(c, A.Unwind) or c.optional for c in q.clauses):
            return None
        paths = [c.pattern for c in q.clauses if isinstance(c.pattern, A.PathPattern)]
        walks = [p for p in paths if p.hops is not None]
        if len(walks) != 2:
            return None
        p1, p2 = walks
        start, t1, t2 = p1.source.var, p1.target.var, p2.target.var
        if None in (start, t1, t2) or len({start, t1, t2}) < 3 or (start, p1.edge_label, p1.hops, p1.direction) != (p2.source.var, p2.edge_label, p2.hops, p2.direction) or not self._known("edge", p1.edge_label):
            return None
        rest = [c.pattern for c in q.clauses if c.pattern not in walks]
        own = lambda p: {v for v in ((p.var,) if isinstance(p, A.NodePattern) else (p.source.var, p.target.var, p.edge_var)) if v}

        def hanging(v: str) -> set[str]:
            found: set[str] = {v}
            while more := set().union(*(own(p) for p in rest if own(p) & found)) - found:
                found |= more
            return found

        first, second, core = hanging(t1), hanging(t2), hanging(start)
        if first & (second | core) or second & core or core == {start} and not any(own(p) & core for p in rest):
            return None
        put = lambda p: self._node(p, False) if isinstance(p, A.NodePattern) else self._path(p, False)
        for p in rest:
            if not own(p) & (first | second):
                put(p)
        if self.env[start].kind != "node":
            return None
        base, env = self.frame, dict(self.env)
        starts = base.select(f"{start}__id", f"{start}__label").distinct()
        self.walked = self._levels(p1, starts.select(self._col(f"{start}__id").alias("start")))
        sides = []
        for walk, vars_, frame, known in ((p1, first, base, env), (p2, second, starts, {start: Binding("node", {})})):
            self.frame, self.env = frame, dict(known)
            put(walk)
            for p in rest:
                if own(p) & vars_:
                    put(p)
            sides.append((self.frame, self.env))
        self.walked = None
        (left, left_env), (right, right_env) = sides
        self.env = {**left_env, **{v: b for v, b in right_env.items() if v != start}}
        x, y = set(left_env), set(right_env) - {start}
        keys = ["_k0"]
        left, right = left.withColumn("_k0", self._col(f"{start}__id")), right.withColumnRenamed(f"{start}__id", "_k0").drop(f"{start}__label")
        tests = []
        for c in _conjuncts(q.where):
            if (v := _vars(c)) <= x:
                left = left.where(self.predicate(c))
            elif v <= y:
                right = right.where(self.predicate(c))
            elif isinstance(c, A.Compare) and c.op == "=" and ((l := _vars(c.left)) <= x and (r := _vars(c.right)) <= y or l <= y and _vars(c.right) <= x) and (a := self.value(c.left)).kind == (b := self.value(c.right)).kind and a.kind in V.NATIVE:
                keys.append(f"_k{len(keys)}")
                a, b = (a, b) if l <= x else (b, a)
                left, right = left.withColumn(keys[-1], a.col), right.withColumn(keys[-1], b.col)
            else:
                tests.append(c)
        return self._paired(left.dropna(subset=keys), right.dropna(subset=keys), x, y, keys, tests)

    def _levels(self, p: A.PathPattern, start: DataFrame) -> DataFrame:
        """What _reach gives for few starts: each round is kept as a table, walks from the newest nodes alone,
        and ends the search when it finds none."""
        least, most = self._hops(p)
        edges = self.graph.table("edge", p.edge_label, [])
        hop = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
        turned = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"))
        hop = hop if p.direction == "out" else turned if p.direction == "in" else hop.unionByName(turned)
        newest, found = stored(start.select("start", F.col("start").alias("node")), "walk"), None
        pairs = newest.where(F.lit(False))
        for d in range(1, most + 1):
            step = newest.join(hop, F.col("node") == F.col("at")).select("start", F.col("to").alias("node")).where("start <> node").distinct()
            newest = stored(step if found is None else step.join(found, ["start", "node"], "left_anti"), "walk")
            if newest.isEmpty():
                break
            found = newest if found is None else found.unionByName(newest)
            pairs = pairs.unionByName(newest) if d >= least else pairs
        return pairs

    def _counted(self, kept: DataFrame, other: DataFrame, keys: list[str], apart: list, above: list) -> DataFrame:
        """The rows of `kept` that have partners in `other`, their number in `_n`: of equal keys, different
        in each pair of values of `apart`, beyond them by those of `above`.  Partners that differ in some
        values are all partners without those equal in one of them, and so on, so that no pair is made."""
        own = [f"_v{i}" for i in range(len(apart))]
        kept = kept.withColumns({n: a for n, (a, _) in zip(own, apart)}).dropna(subset=own) if own else kept
        other = other.select(*keys, *[b.alias(n) for n, (_, b) in zip(own, apart)], *[b.alias("_x") for _, b, _ in above]).dropna()
        names = kept.columns
        if above:
            ((a, _, up),) = above
            kept = kept.withColumn("_x", a).where("_x is not null").withColumn("_other", F.lit(0))
            rows = kept.unionByName(other.withColumn("_other", F.lit(1)), allowMissingColumns=True)
        total = F.lit(0).cast("long")
        for bits in range(1 << len(own)):
            by = [*keys, *(n for i, n in enumerate(own) if bits >> i & 1)]
            n, sign = f"_n{bits}", -1 if bits.bit_count() % 2 else 1
            if above:
                beyond = Window.partitionBy(*by).orderBy(F.col("_x").desc() if up else F.col("_x").asc(), "_other").rowsBetween(Window.unboundedPreceding, 0)
                rows = rows.withColumn(n, F.sum("_other").over(beyond))
            else:
                kept = kept.join(other.groupBy(*by).agg(F.count(F.lit(1)).alias(n)), by, "left" if bits else "inner")
            total = total + sign * F.coalesce(F.col(n), F.lit(0))
        self.many = True
        found = rows.where("_other = 0") if above else kept
        return found.withColumn("_n", total).where("_n > 0").select(*[self._col(c) for c in names if c not in (*keys, *own)], "_n")

    def _filtered(self, frame: DataFrame, predicate: Any) -> DataFrame:
        self.frame = frame
        test = self.predicate(predicate)  # may add columns to the frame
        return self.frame.where(test)

    # --- projection
    def _order(self) -> list[Column]:
        """Columns that follow the order in which matches come: each variable by label and id."""
        out = []
        for name, b in self.env.items():
            if b.kind == "node":
                out += [self._col(f"{name}__label"), self._col(f"{name}__id")]
            elif b.kind == "edge":
                out += [self._col(f"{name}__label"), self._col(f"{name}__src"), self._col(f"{name}__dst")]
        return out

    def _aggregate(self, a: A.Agg, order: list[Column]) -> tuple[Column, str, str | None]:
        if a.kind == "count_star":
            return F.count(F.lit(1)), "int", None
        v = self.value(a.arg)
        c = v.col if v.kind != "missing" else F.lit(None).cast("string")
        present = c if v.kind != "tagged" else F.when(c["t"] != 0, c)
        if v.kind == "null":
            present = F.lit(None).cast("string")
        if a.kind == "count":
            return F.count(present), "int", None
        if a.kind == "count_distinct":
            return F.count_distinct(present), "int", None
        if a.kind == "size":
            text = F.char_length(V.as_string(v)).cast("long") if v.kind not in ("missing", "list", "null") else F.lit(None).cast("long")
            return F.min_by(text, F.struct(*order) if order else F.lit(0)), "int", None
        kind = "tagged" if v.kind in ("tagged", "null") else "str" if v.kind == "missing" else v.kind
        c = V.tagged(v) if kind == "tagged" else c
        if a.kind == "collect":
            pair = F.when(c.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], c.alias("value")))
            return F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["value"]), "list", kind
        pair = F.when(c.isNotNull(), F.struct(V.sort_key(V.Val(kind, c)).alias("key"), c.alias("value")))
        return F.transform(F.array_sort(F.collect_set(pair)), lambda x: x["value"]), "list", kind

    def project(self, items: tuple, frame: DataFrame) -> tuple[DataFrame, dict[str, V.Val]]:
        """Items -> a frame with their columns alone; of equal names the last one counts."""
        self.frame = frame
        named = {i.name: i for i in items}
        keys, aggs = {}, {}
        for name, i in named.items():
            if isinstance(i.value, A.Agg):
                aggs[name] = self._aggregate(i.value, self._order() if i.value.kind in ("collect", "size") else [])
            else:
                v = self.value(i.value)
                if v.kind in ("missing", "null"):
                    v = V.Val("str", F.lit(None).cast("string"))
                keys[name] = v
        if not aggs:
            out = frame.select(*[v.col.alias(n) for n, v in keys.items()], *["_n"] * self.many)
        else:
            # without a key a constant one: no rows make no group
            by = [v.col.alias(n) for n, v in keys.items()] or [F.lit(1).alias("_all")]
            out = frame.groupBy(*by).agg(*[c.alias(n) for n, (c, _, _) in aggs.items()])
            out = out.select(*[self._col(n) for n in named])
        vals = {}
        for n in named:
            if n in aggs:
                _, kind, element = aggs[n]
                vals[n] = V.Val(kind, self._col(n), element)
            else:
                vals[n] = replace(keys[n], col=self._col(n), constant=None)
        return out, vals

    def compile(self) -> tuple[DataFrame, dict[str, V.Val], list[Column]]:
        """The result, its columns, and what orders it (empty without ORDER BY and LIMIT)."""
        q = self.query
        frame = self._pair()
        frame = self._star() if frame is None else frame
        if frame is None:
            self.env, self.frame, self.made = {}, None, {}
            self.patterns()
            frame = self.frame if self.frame is not None else self._one()
            if q.where is not None:
                frame = self._filtered(frame, q.where)
        if q.with_ is not None:
            frame, vals = self.project(q.with_.items, frame)
            self.made = {}
            self.env = {n: Binding("value", val=v) for n, v in vals.items()}
            if q.with_.where is not None:
                frame = self._filtered(frame, q.with_.where)
        out, vals = self.project(q.return_.items, frame)
        if q.return_.distinct:
            out = out.drop("_n").distinct()
        order = []
        for name, up in q.return_.order:
            if (v := vals.get(name)) is not None:
                keys = [F.size(v.col)] if v.kind == "list" else [v.col] if v.kind != "tagged" else [F.when(v.col["t"] != 0, v.col)]
                order += [c.asc_nulls_first() if up else c.desc_nulls_last() for c in keys]
        if order or q.return_.limit is not None:
            by = [*order, F.col("_row").asc()]
            order.append(row_key(vals).asc())
            if not self.many or q.return_.distinct:
                keyed = out.withColumn("_row", row_key(vals))  # made once, not in each comparison
                out = (keyed.sortWithinPartitions(*by) if self.placed else keyed.orderBy(*by)).drop("_row")
        if self.many and not q.return_.distinct:
            out = repeated(out, "_n", order)
        if q.return_.limit is not None:
            out = out.limit(q.return_.limit)
        return out, vals, order


def row_key(vals: dict[str, V.Val]) -> Column:
    """The string by which rows without an order come: columns by name, values by tagged text."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{n}="), V.sort_key(v)) for n, v in sorted(vals.items())])
