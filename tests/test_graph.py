"""Language semantics on tiny graphs: the traps first."""

import pytest

from graphloom.engine import Engine, UnknownKeyspace, program, programs
from graphloom.operators import dump, enrich, reports
from graphloom.plans import ast as A
from graphloom.plans.builder import QueryBuilder
from graphloom.plans.lint import lint_shape
from graphloom.plans.parser import ParseError, parse
from graphloom.sources.graph import load_json, load_tables, save_json, save_tables


def N(i, label="N", **props):
    return {"id": i, "label": label, "props": props}


def E(s, d, label="R", **props):
    return {"src": s, "dst": d, "label": label, "props": props}


@pytest.fixture(scope="module")
def eng(spark):
    e = Engine(spark)
    e.ingest("k", [N("a", x=1, s="1", n=None), N("b", x=2, s="é"), N("c", x=3), N("d", "M", y=-5, mixed="t"), N("f", "M", y=4, mixed=7)],
             [E("a", "b", w=7), E("a", "b", w=8), E("b", "c"), E("c", "a"), E("c", "c"), E("d", "a", "S"), E("a", "zzz")])
    return e


CASES = [
    ("MATCH (n:N) WHERE n.x > 99 RETURN count(*)", []),
    ("MATCH (n:N) WHERE NOT n.nope = 1 RETURN count(*)", [{"count": 3}]),
    ("MATCH (n:N) WHERE n.s <> 1 RETURN n.x", []),
    ("MATCH (n:N) WHERE n.n = null RETURN n.x", [{"n.x": 1}]),
    ("MATCH (n:N) WHERE n.x IN [1.0, 3] RETURN n.x", [{"n.x": 3}]),
    ("MATCH (n:N) WHERE n.x = 1.0 RETURN n.x", [{"n.x": 1}]),
    ("MATCH (n:N) WHERE n.s =~ '^\\\\w$' RETURN n.x AS x ORDER BY x", [{"x": 1}, {"x": 2}]),
    ("MATCH (n:N) WHERE n.s =~ '(' RETURN n.x", []),
    ("MATCH (n:N) WHERE NOT EXISTS { MATCH (n:N) WHERE n.x = 1 } RETURN n.x", []),
    ("MATCH (n:N) WHERE NOT EXISTS { MATCH (n:N) WHERE n.x = 9 } RETURN count(*)", [{"count": 3}]),
    ("MATCH (a:N)-[:R*1..8]->(b:N) RETURN a AS a, b AS b", [{"a": x, "b": y} for x in "abc" for y in "abc" if x != y]),
    ("MATCH (a:N {x: 1})-[:R*2..5]->(b) RETURN b AS b", [{"b": "c"}]),
    ("MATCH (a:N)-[r:R]->(b:N) RETURN a AS a, count(r) AS n ORDER BY n DESC, a", [{"a": "a", "n": 2}, {"a": "c", "n": 2}, {"a": "b", "n": 1}]),
    ("MATCH (c:N {x: 3})-[:R]-(o) RETURN o AS o", [{"o": "a"}, {"o": "b"}, {"o": "c"}, {"o": "c"}]),
    ("MATCH (a)-[r]->(b:N {x: 1}) RETURN r.label AS l, r.src AS s, r AS bare", [{"l": "R", "s": "c", "bare": "R"}, {"l": "S", "s": "d", "bare": "S"}]),
    ("MATCH (n:N) WITH n AS m RETURN m AS m, m.x AS x", [{"m": i, "x": None} for i in "abc"]),
    ("MATCH (n:N) OPTIONAL MATCH (n)-[:S]-(m:M) RETURN n AS n, m AS m", [{"n": "a", "m": "d"}, {"n": "b", "m": None}, {"n": "c", "m": None}]),
    ("MATCH (m:M) RETURN m.mixed AS v ORDER BY v", None),
    ("MATCH (m:M) RETURN collect(DISTINCT m.y) AS ys", [{"ys": [-5, 4]}]),
    ("MATCH (n:N) RETURN collect(n.n) AS ns, collect(n.s) AS ss", [{"ns": [None], "ss": ["1", "é"]}]),
    ("MATCH (n:N) RETURN size(n.s) AS z", [{"z": 1}]),
    ("UNWIND $l AS v RETURN v ORDER BY v", [{"v": 1}, {"v": 1}, {"v": 2}]),
    ("UNWIND $no AS v RETURN v", []),
    ("MATCH (n:Nope) RETURN n", []),
    ("MATCH (n:N)-[:NOPE]->(m) RETURN n", []),
    ("MATCH (n:N) RETURN n.x AS x ORDER BY nothing LIMIT 2", [{"x": 1}, {"x": 2}]),
    ("MATCH (n:N) RETURN n.x AS x LIMIT 0", []),
    ("MATCH (a:N), (b:N) WHERE a.x < b.x RETURN a.x AS a, b.x AS b", [{"a": 1, "b": 2}, {"a": 1, "b": 3}, {"a": 2, "b": 3}]),
    ("MATCH (a:N)-[:R]->(b:N), (b:N {x: 3}) RETURN a AS a", [{"a": "b"}, {"a": "c"}]),
    ("MATCH (a:N)-[:R]->(a) RETURN a AS a", [{"a": "c"}]),
    ("MATCH (n:N) OPTIONAL MATCH (n)-[:S]-(m:M) WITH n.x AS x, collect(m.y) AS ys WHERE size(ys) = 0 RETURN x", [{"x": 2}, {"x": 3}]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_semantics(eng, text, want):
    rows = eng.execute("k", text, {"l": [2, 1, 1]}).rows()
    if want is None:
        assert sorted(map(str, (r["v"] for r in rows))) == ["7", "t"]
    else:
        key = lambda r: str(sorted(r.items(), key=lambda kv: kv[0]))
        assert (rows if "ORDER" in text else sorted(rows, key=key)) == (want if "ORDER" in text else sorted(want, key=key))


def test_warnings_and_keyspaces(eng):
    r = eng.execute("k", "MATCH (n:NN) RETURN n")
    r.rows()
    assert [w.kind for w in r.warnings] == ["Ingest", "UnknownLabel"] and "zzz" in r.warnings[0].message
    assert eng.list_keyspaces() == ["k"]
    with pytest.raises(UnknownKeyspace):
        eng.execute("none", "MATCH (n) RETURN n")


@pytest.mark.parametrize("text,line,column", [("CREATE (n)", 1, 1), ("MATCH (n)\nRETURN n;", 2, 9), ("MATCH (n RETURN n", 1, 10), ("MATCH (a)-->(b) RETURN a", 1, 11), ("RETURN 1", 1, 1), ("MATCH (n) WHERE n.x RETURN n", 1, 21), ("MATCH (a)-[:R*3]->(b) RETURN a", 1, 16), ("MATCH (n) RETURN 'x", 1, 18)])
def test_rejected(text, line, column):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert (e.value.line, e.value.column) == (line, column)


def test_accepted():
    q = parse("/* c */ match (a:L {k: 'its', z: -2})-[r:E]->(b) // end\nwhere a.x = 1 or a.y = 2 and not b.z in [1, 2] return distinct a.x as x, count(*) order by x desc limit 3")
    assert isinstance(q.where, A.Or) and q.return_.distinct and q.return_.order == (("x", False),) and q.return_.limit == 3
    built = QueryBuilder().match_path(A.NodePattern("a", "L"), "E", A.NodePattern("b")).where_eq("a.x", 1).where_regex("b.s", "q").return_items("a.x").order_by("a.x").limit(5).build()
    assert built == parse("MATCH (a:L)-[:E]->(b) WHERE a.x = 1 AND b.s =~ 'q' RETURN a.x ORDER BY a.x LIMIT 5")
    assert lint_shape(parse("MATCH (a:I), (b:I) WHERE last_segment(a.q) = last_segment(b.q) RETURN a"))
    for name in programs():
        parse(program(name))


def test_storage_and_dump(eng, tmp_path):
    g = eng.graph("k")
    save_json(g, str(tmp_path / "a.json"))
    back = load_json(eng.spark, f"file://{tmp_path}/a.json")
    assert dump.canonical_dump(back) == dump.canonical_dump(g) == dump.canonical_dump(g)
    save_json(back, str(tmp_path / "b.json"))
    assert (tmp_path / "a.json").read_bytes() == (tmp_path / "b.json").read_bytes()
    save_tables(g, f"file://{tmp_path}/t")
    assert dump.canonical_dump(load_tables(eng.spark, f"file://{tmp_path}/t")) == dump.canonical_dump(g)
    (tmp_path / "c.json").write_text('{"schema_version": {"major": 9, "minor": 0, "patch": 0}, "nodes": [], "edges": []}')
    with pytest.raises(ValueError):
        load_json(eng.spark, f"file://{tmp_path}/c.json")


def code_graph(spark):
    item = lambda q, **p: N(f"item:{q}", "Item", qname=q, name=q.split("::")[-1], **{"kind": "fn", "crate": q.split("::")[0], "bounded_context": q.split("::")[0], "file": f"{q}.rs", "line": 1, "is_test": False, "is_deprecated": False, "signature": "fn()"} | p)
    nodes = [item("x::run"), item("x::price_from_a"), item("x::price_from_b"), item("y::run", signature="fn(u8)"), item("x::old", is_deprecated=True), N("entrypoint:cli", "EntryPoint", name="cli", kind="cli_command", handler_qname="x::run"),
             item("x::Shared", kind="struct", bounded_context="w"), item("y::Shared", kind="struct"), N("context:x", "Context", name="x", canonical_crate="", owning_rfc=None), N("context:z", "Context", name="gone", canonical_crate="nope", owning_rfc="RFC-9"), N("crate:x", "Crate", name="x"), N("rfc:a", "RfcDoc", path="docs/a.md", title=None)]
    edges = [E("entrypoint:cli", "item:x::run", "EXPOSES"), E("item:x::run", "item:x::price_from_a", "CALLS"), E("item:x::run", "item:x::price_from_b", "CALLS")]
    from graphloom.sources.graph import graph_of

    return graph_of(spark, nodes, edges)


def test_enrich_and_reports(spark):
    g, report = enrich.reachability(code_graph(spark))
    assert report.ran and {r.qname: r.reachable_entry_count for r in g.nodes["Item"].collect()} == {"x::run": 1, "x::price_from_a": 1, "x::price_from_b": 1, "y::run": 0, "x::old": 0, "x::Shared": 0, "y::Shared": 0}
    s = reports.scope(g, "x")
    assert [(r["class"], r["qname"]) for r in s.findings.collect()] == [("context_homonym", "x::run"), ("unfinished_refactor", "x::old"), ("random_scattering", "x::price_from_a"), ("unwired", "x::old")]
    assert [(r.crate, r.n) for r in s.items_by_crate.collect()] == [("x", 4)] and [(r.name, r.crates) for r in s.candidates.collect()] == [("Shared", ["x", "y"])]
    assert [w.split(" ")[0] for w in s.warnings] == ["duplicated_feature", "canonical_bypass"]
    with pytest.raises(ValueError):
        reports.scope(g, "z")
    d = dump.diff(code_graph(spark), g)
    assert d.added.count() == d.removed.count() == 0 and d.changed.count() == 7
    assert reports.classify(s, d).count() == 4 and reports.classify_jsonl(s, reports.classify(s, d)).count("\n") == 4 + len(s.warnings)
    e = Engine(spark)
    e.add("k", g)
    rows, code = e.violations("k", "vertical-split-brain")
    assert code == 30 and rows == [{"entry_point": "cli", "entry_qname": "x::run", "concept_prefix": "price_from_", "resolver_a_qname": "x::price_from_a", "resolver_b_qname": "x::price_from_b", "divergence_kind": "fork"}]
    docs = spark.createDataFrame([("d.md", "# T\nsee x::run and price_from_a, running")], "path string, text string")
    g2, _ = enrich.rfc_docs(g, docs)
    assert {r.src for r in g2.edges["REFERENCED_BY"].collect()} == {"item:x::run", "item:y::run", "item:x::price_from_a"}
    commits = spark.createDataFrame([("x::run.rs", 5, "a"), ("x::run.rs", 9, "b")], "path string, commit_ts long, author_email string")
    g3, _ = enrich.git_history(g, commits)
    e.add("h", g3)
    assert e.execute("h", "MATCH (i:Item) WHERE i.git_last_author = null RETURN count(*) AS n").rows() == [{"n": 6}]
    assert e.execute("h", "MATCH (i:Item) WHERE i.git_last_author = 'b' RETURN i.git_commit_count AS n").rows() == [{"n": 2}]


def test_bans_and_bypasses(spark):
    """The programs on callers: one that each finds, and one that each leaves out."""
    e = Engine(spark)
    items = [("dom", "domain-market", None), ("dom_test", "domain-market", None), ("ad", "adapters-x", None), ("infra", "infra-utils", None), ("svc::pay", "svc", True), ("svc::old", "svc", False)]
    calls = [("dom", "Decimal::from_f64", "crates/domain/a.rs"), ("dom_test", "Decimal::from_f64", "crates/domain/a.rs"), ("ad", "reqwest::Client::new", "crates/adapters/b.rs"), ("infra", "reqwest::Client::new", "crates/adapters/infra-utils/c.rs"), ("ad", "x::to_f64", "crates/adapters/b.rs"),
             ("svc::pay", "ledger::post", "p.rs"), ("svc::pay", "raw::append", "p.rs"), ("svc::old", "raw::append", "o.rs")]
    nodes = [N(q, "Item", qname=q, crate=c, is_test=q.endswith("_test"), **({} if r is None else {"reachable_from_entry": r})) for q, c, r in items]
    nodes += [N(f"cs{k}", "CallSite", callee_path=p, callee_last_segment=p.split("::")[-1], file=f, is_test=False) for k, (_, p, f) in enumerate(calls)]
    e.ingest("k", nodes, [E(q, f"cs{k}", "INVOKES_AT") for k, (q, _, _) in enumerate(calls)])
    of = lambda rule, **params: ([set(r.values()) for r in e.violations("k", rule, params)[0]], e.violations("k", rule, params)[1])
    assert of("arch-ban-f64-in-domain") == ([{"dom", "domain-market", "crates/domain/a.rs", "Decimal::from_f64"}], 30)
    assert of("arch-ban-reqwest-client-new") == ([{"ad", "adapters-x", "crates/adapters/b.rs", "reqwest::Client::new"}], 30)
    own = {"concept": "posting", "caller_regex": "svc::.*"}
    assert of("canonical-bypass-caller", canonical_callee_name="post", **own) == ([{"posting", "ledger::post", "svc::pay", "CANONICAL_CALLER", "p.rs"}], 30)
    assert of("canonical-bypass-reachable", bypass_callee_name="append", **own) == ([{"posting", "raw::append", "svc::pay", "BYPASS_REACHABLE", "p.rs"}], 30)
    assert of("canonical-bypass-dead", bypass_callee_name="append", **own) == ([{"posting", "raw::append", "svc::old", "BYPASS_DEAD", "o.rs"}], 30)
    assert of("canonical-bypass-dead", bypass_callee_name="post", **own) == ([], 0)


def test_vertical_split_brain_drop(spark):
    e = Engine(spark)
    nodes = [N("ep", "EntryPoint", name="GET /x", handler_qname="h"), N("w", "Param", name="limit"), N("ok", "Param", name="limit"), N("bad", "Param", name="max")]
    nodes += [N(q, "Item", qname=q, is_test=q == "t") for q in ("h", "a", "b", "t")]
    e.ingest("k", nodes, [E("ep", "w", "REGISTERS_PARAM"), E("ep", "h", "EXPOSES"), E("h", "a", "CALLS"), E("a", "b", "CALLS"), E("h", "t", "CALLS"), E("a", "ok", "HAS_PARAM"), E("b", "bad", "HAS_PARAM"), E("t", "bad", "HAS_PARAM")])
    rows, code = e.violations("k", "vertical-split-brain-drop")
    assert (rows, code) == ([{"entry_point": "GET /x", "entry_qname": "h", "wire_param": "limit", "matching_resolver": "a", "divergent_resolver": "b", "divergent_key": "max", "divergence_kind": "drop"}], 30)


def test_checks(spark):
    """Empty and missing declarations don't fire; a context is unwired if no item has it."""
    g = code_graph(spark)
    rows = [(r.verdict, r.context_name, r.evidence) for r in reports.check_t1(g).collect()]
    assert rows == [("CONCEPT_UNWIRED", "gone", "gone"), ("MISSING_CANONICAL_CRATE", "gone", "nope"), ("STALE_RFC_REFERENCE", "gone", "RFC-9")]
    (t3,) = reports.check_t3(g).collect()
    assert (t3.name, t3.kind, t3.n, t3.n_crates, t3.n_contexts, t3.is_cross_context, t3.canonical_candidate) == ("Shared", "struct", 2, 2, 2, True, None)
    r = reports.list_items_matching(g, "^run$", ["Fn", "ImplBlock"])
    assert [x["qname"] for x in r.rows()] == ["x::run", "y::run"] and r.warnings[0].kind == "EmptyResult"


def test_source_bound_to_null(eng):
    """A source that an optional pattern left null is enumerated anew, in each of its forms."""
    found = lambda text: sorted(tuple(r.values()) for r in eng.execute("k", text).rows())
    assert found("MATCH (n:N) OPTIONAL MATCH (n)-[:S]-(m:M) MATCH (m)-[:S]->(t) RETURN m AS m, n AS n") == [("d", "a"), ("d", "b"), ("d", "c")]
    assert found("MATCH (n:N) OPTIONAL MATCH (n)-[:S]-(m:M) MATCH (t)-[:S]->(m) RETURN n AS n") == []
    assert len(found("MATCH (n:N) OPTIONAL MATCH (n)-[:NONE]->(m:N) MATCH (m)-[:R]->(t) RETURN n AS n, m AS m, t AS t")) == 3 * 5
    assert found("UNWIND $l AS m MATCH (m)-[:S]->(t) RETURN m AS m") == []
