"""The engine: keyspaces of facts, queries, rule programs."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .functions.values import Val, untag
from .plans import ast as A
from .plans.compiler import MOST_HOPS, Compiler, Warning_, row_key
from .plans.lint import lint_shape
from .plans.parser import parse
from .rules import HOPS, PROGRAMS
from .sources.graph import SCHEMA_VERSION, Graph, graph_of, load_json, merged, save_json


class UnknownKeyspace(KeyError):
    pass


@dataclass
class QueryResult:
    df: DataFrame
    columns: dict[str, Val]
    warnings: list[Warning_] = field(default_factory=list)
    ordered: bool = False

    def rows(self) -> list[dict[str, Any]]:
        """On the driver: columns by name, rows in the language's default order unless they have one."""
        df = self.df if self.ordered else self.df.orderBy(row_key(self.columns))
        out = []
        for r in df.collect():
            row = {}
            for n, v in sorted(self.columns.items()):
                x = r[n]
                if v.kind == "tagged":
                    x = untag(x)
                elif v.kind == "list" and v.element == "tagged":
                    x = [untag(y) for y in x]
                row[n] = x
            out.append(row)
        if not out and not any(w.kind in ("UnknownLabel", "UnknownEdgeLabel") for w in self.warnings):
            self.warnings.append(Warning_("EmptyResult", "no rows match"))
        return out


def run_query(graph: Graph, query: A.Query | str, params: dict | None = None, most_hops: int = MOST_HOPS) -> QueryResult:
    """params: scalars, lists, or tables of one column for lists of any length."""
    query = parse(query) if isinstance(query, str) else query
    compiler = Compiler(graph, query, params, most_hops)
    df, columns, order = compiler.compile()
    warnings = [Warning_("Ingest", w) for w in graph.warnings] + compiler.warnings
    return QueryResult(df, columns, warnings, bool(order))


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._graphs: dict[str, Graph] = {}

    def add(self, keyspace: str, graph: Graph) -> Graph:
        """Adds a graph to a keyspace, which is made if it is new."""
        old = self._graphs.get(keyspace)
        self._graphs[keyspace] = graph if old is None else merged(old, graph)
        return self._graphs[keyspace]

    def ingest(self, keyspace: str, nodes: list[dict], edges: list[dict]) -> Graph:
        return self.add(keyspace, graph_of(self.spark, nodes, edges))

    def load(self, keyspace: str, path: str) -> Graph:
        return self.add(keyspace, load_json(self.spark, path))

    def save(self, keyspace: str, path: str) -> None:
        save_json(self.graph(keyspace), path)

    def graph(self, keyspace: str) -> Graph:
        if keyspace not in self._graphs:
            raise UnknownKeyspace(keyspace)
        return self._graphs[keyspace]

    def replace(self, keyspace: str, graph: Graph) -> None:
        self._graphs[keyspace] = graph

    def list_keyspaces(self) -> list[str]:
        return sorted(self._graphs)

    def drop(self, keyspace: str) -> None:
        self._graphs.pop(keyspace, None)

    def schema_version(self) -> tuple[int, int, int]:
        return SCHEMA_VERSION

    def execute(self, keyspace: str, query: A.Query | str, params: dict | None = None, most_hops: int = MOST_HOPS) -> QueryResult:
        return run_query(self.graph(keyspace), query, params, most_hops)

    def query(self, keyspace: str, text: str, params: dict | None = None, most_hops: int = MOST_HOPS) -> dict[str, Any]:
        """Parses, binds scalar parameters, advises and runs: rows, warnings and advice as plain data."""
        for k, v in (params or {}).items():
            if isinstance(v, (list, dict)):
                raise ValueError(f"parameter {k} must be a scalar")
        tree = parse(text)
        result = self.execute(keyspace, tree, params, most_hops)
        rows = result.rows()
        return {"rows": rows, "warnings": [w.__dict__ for w in result.warnings], "advice": lint_shape(tree)}

    def violations(self, keyspace: str, rule: str, params: dict | None = None, no_fail: bool = False) -> tuple[list[dict], int]:
        """Rows of a rule program and an exit code: 30 where there are any."""
        rows = run_rule(self.graph(keyspace), rule, params).rows() if rule in programs() else self.execute(keyspace, rule, params).rows()
        return rows, 30 if rows and not no_fail else 0

    def list_callers(self, keyspace: str, qname: str) -> list[dict]:
        return self.execute(keyspace, program("list-callers"), {"qname": qname}).rows()

    def explain(self, keyspace: str, query: A.Query | str, params: dict | None = None) -> str:
        df = self.execute(keyspace, query, params).df
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def programs() -> list[str]:
    """Names of the rule programs."""
    return sorted(PROGRAMS)


def program(name: str) -> str:
    if name not in PROGRAMS:
        raise ValueError(f"no rule program {name!r}")
    return PROGRAMS[name]


def run_rule(graph: Graph, name: str, params: dict | None = None) -> QueryResult:
    """A rule program's rows, its walks as long as the program says."""
    return run_query(graph, program(name), params, HOPS.get(name, MOST_HOPS))
