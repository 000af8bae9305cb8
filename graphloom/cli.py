"""The command line: python -m graphloom.cli VERB --db FOLDER --keyspace NAME ...

A keyspace is a folder of Parquet tables, FOLDER/NAME, or a file FOLDER/NAME.json.  Results are JSON on
standard output; rule findings end with 30, errors with 1.
"""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys

from . import schema
from .engine import HOPS, MOST_HOPS, Engine, program, programs
from .operators import dump, enrich, reports
from .sources import producers, readers, toml_specs
from .sources.graph import SCHEMA_VERSION, Graph, graph_of_facts, load_json, load_tables, save_json, save_tables

FOUND = 30


class Failure(Exception):
    pass


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("graphloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    from .shipping import ship

    ship(spark)
    return spark


def keyspaces(db: str) -> list[str]:
    """Names in a folder; none without a folder."""
    if not os.path.isdir(db):
        return []
    return sorted({n.removesuffix(".json") for n in os.listdir(db) if n.endswith(".json") or os.path.isdir(os.path.join(db, n, "graph"))})


def _path(db: str, name: str) -> str:
    if os.path.basename(name) != name or name in ("", ".", ".."):
        raise Failure(f"{name!r} is no keyspace name")
    return os.path.join(os.path.abspath(db), name)


def load(spark, a) -> Graph:
    path = _path(a.db, a.keyspace)
    if os.path.isdir(os.path.join(path, "graph")):
        return load_tables(spark, f"file://{path}")
    if os.path.exists(f"{path}.json"):
        return load_json(spark, f"file://{path}.json")
    raise Failure(f"no keyspace {a.keyspace!r} in {a.db}; there are: {', '.join(keyspaces(a.db)) or 'none'}")


def save(graph: Graph, a) -> None:
    """Writes beside the old tables first: a graph may still read from them."""
    path = _path(a.db, a.keyspace)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    save_tables(graph, f"file://{path}.new")
    shutil.rmtree(path, ignore_errors=True)
    os.rename(f"{path}.new", path)


def _rows(graph: Graph, spark, text: str, params: dict | None = None, most_hops: int = MOST_HOPS) -> dict:
    e = Engine(spark)
    e.replace("k", graph)
    return e.query("k", text, params, most_hops)


def _records(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def run(a, spark=None) -> tuple[object, int]:
    """A verb's result as plain data, and the exit code."""
    if a.verb == "version":
        return {"schema_version": ".".join(map(str, SCHEMA_VERSION))}, 0
    if a.verb == "schema-describe":
        return schema.schema_describe(), 0
    if a.verb == "list-keyspaces":
        return keyspaces(a.db), 0
    if a.verb == "snapshots":
        return [{"keyspace": k, "schema_version": ".".join(map(str, SCHEMA_VERSION)), "sha": None, "timestamp": None} for k in keyspaces(a.db)], 0
    if a.verb == "drop":
        path = _path(a.db, a.keyspace)
        if a.keyspace not in keyspaces(a.db):
            raise Failure(f"no keyspace {a.keyspace!r} in {a.db}")
        shutil.rmtree(path, ignore_errors=True)
        if os.path.exists(f"{path}.json"):
            os.remove(f"{path}.json")
        return {"dropped": a.keyspace}, 0
    if a.verb in ("find-canonical", "list-bypasses"):
        return {"verb": a.verb, "ran": False, "keyspace": a.keyspace, "warnings": [f"{a.verb}: not implemented"]}, 0
    spark = spark or session()
    if a.verb == "extract":
        facts, warnings = producers.extract(spark, a.workspace)
        graph = graph_of_facts(facts)
        save(graph, a)
        return {"keyspace": a.keyspace, "nodes": {k: graph.nodes[k].count() for k in sorted(graph.nodes)}, "edges": {k: graph.edges[k].count() for k in sorted(graph.edges)}, "warnings": warnings + graph.warnings}, 0
    graph = load(spark, a)
    if a.verb == "query":
        params = json.loads(a.params) if a.params else {}
        return _rows(graph, spark, open(a.input, encoding="utf-8").read() if a.input else a.cypher, params), 0
    if a.verb == "violations":
        text = program(a.rule) if a.rule in programs() else open(a.rule, encoding="utf-8").read()
        out = _rows(graph, spark, text, json.loads(a.params) if a.params else {}, HOPS.get(a.rule, MOST_HOPS))
        return {"violations": len(out["rows"])} if a.count_only else out, FOUND if out["rows"] and not a.no_fail else 0
    if a.verb == "list-callers":
        return _rows(graph, spark, program("list-callers"), {"qname": a.qname}), 0
    if a.verb == "list-items-matching":
        r = reports.list_items_matching(graph, a.name_pattern, a.kinds.split(",") if a.kinds else None, a.group_by_context)
        return {"rows": r.rows(), "warnings": [w.__dict__ for w in r.warnings]}, 0
    if a.verb == "scope":
        s = reports.scope(graph, a.context)
        classes = {c: [] for c in reports.CLASSES}
        for r in _records(s.findings):
            classes[r.pop("class")].append(r)
        return {"context": s.context, "keyspace_sha": a.keyspace, "findings_by_class": classes, "canonical_candidates": _records(s.candidates), "reachability_map": None, "loc_per_crate": {r.crate: r.n for r in s.items_by_crate.collect()}, "warnings": s.warnings}, 0
    if a.verb in ("diff", "classify"):
        other = load(spark, argparse.Namespace(db=a.db, keyspace=a.against))
        d = dump.diff(other, graph, tuple(a.kinds.split(",")) if a.verb == "diff" and a.kinds else ("node", "edge"))
        if a.verb == "diff":
            return dump.diff_envelope(d, a.against, a.keyspace), 0
        s = reports.scope(graph, a.context)
        return [json.loads(x) for x in reports.classify_jsonl(s, reports.classify(s, d)).split("\n")], 0
    if a.verb == "check":
        found = _records({"T1": reports.check_t1, "T3": reports.check_t3}[a.trigger](graph))
        return {"rows": found}, FOUND if found and not a.no_fail else 0
    if a.verb == "check-predicate":
        contexts = toml_specs.load_contexts(os.path.join(a.workspace, ".cfdb", "concepts"))
        with open(os.path.join(a.workspace, ".cfdb", "predicates", f"{a.name}.cypher"), encoding="utf-8") as f:
            found = _records(reports.check_predicate(graph, f.read(), a.param or [], contexts))
        return {"rows": found}, FOUND if found and not a.no_fail else 0
    if a.verb == "dump":
        return dump.canonical_dump(graph), 0
    if a.verb == "export":
        save_json(graph, a.output)
        return {"written": a.output}, 0
    verb = a.verb.removeprefix("enrich-").replace("-", "_")
    given: list = []
    if verb in ("git_history", "rfc_docs") and not a.workspace:
        return enrich.Report(verb, False, warnings=["no workspace"]).__dict__, 0
    if verb == "git_history":
        given = [readers.git_commits(spark, a.workspace)]
    elif verb == "rfc_docs":
        given = [readers.markdown(spark, a.workspace)]
    elif verb in ("bounded_context", "concepts"):
        contexts = toml_specs.load_contexts(os.path.join(a.workspace or ".", ".cfdb", "concepts"))
        given = [contexts.by_crate if verb == "bounded_context" else contexts.declared]
    elif verb == "metrics" and a.coverage:
        given = [enrich.coverage_of(spark.read.json(f"file://{os.path.abspath(a.coverage)}", multiLine=True))]
    graph, report = enrich.enrich(graph, verb, *given)
    if report.ran:
        save(graph, a)
    return report.__dict__, 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *more: tuple, keyspace: bool = True, db: bool = True) -> None:
        p = verbs.add_parser(name)
        if db:
            p.add_argument("--db", required=True)
        if keyspace:
            p.add_argument("--keyspace", required=True)
        for flags, options in more:
            p.add_argument(*flags.split(), **options)

    need, flag, text = {"required": True}, {"action": "store_true"}, {"default": None}
    verb("version", keyspace=False, db=False)
    verb("schema-describe", keyspace=False, db=False)
    verb("list-keyspaces", keyspace=False)
    verb("snapshots", keyspace=False)
    verb("drop")
    verb("dump")
    verb("export", ("--output", need))
    verb("extract", ("--workspace", need))
    verb("query", ("cypher", {"nargs": "?"}), ("--params", text), ("--input", text))
    verb("violations", ("--rule", need), ("--params", text), ("--count-only", flag), ("--no-fail", flag))
    verb("list-callers", ("--qname", need))
    verb("list-items-matching", ("--name-pattern", need), ("--kinds", text), ("--group-by-context", flag))
    verb("scope", ("--context", need))
    verb("diff", ("--against", need), ("--kinds", text))
    verb("classify", ("--against", need), ("--context", need))
    verb("check", ("--trigger", {"required": True, "choices": ["T1", "T3"]}), ("--no-fail", flag))
    verb("check-predicate", ("--name", need), ("--workspace", {"default": "."}), ("--param", {"action": "append"}), ("--no-fail", flag))
    verb("find-canonical", ("--concept", need))
    verb("list-bypasses", ("--concept", need))
    for name in enrich.VERBS:
        verb("enrich-" + name.replace("_", "-"), ("--workspace", text), ("--coverage", text))
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        out, code = run(parser().parse_args(argv), spark)
    except (Failure, ValueError, OSError) as e:
        print(f"graphloom: {e}", file=sys.stderr)
        return 1
    print(out if isinstance(out, str) else json.dumps(out, indent=2, ensure_ascii=False, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
