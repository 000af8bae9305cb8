"""Producers, readers, storage and the command line on a small workspace."""

import json
import subprocess

import pytest

from graphloom import cli, schema
from graphloom.operators import dump
from graphloom.sources import producers
from graphloom.sources.graph import graph_of, graph_of_facts, load_json, save_json

FILES = {
    "Cargo.toml": '[workspace]\nmembers = ["a"]\n',
    "a/Cargo.toml": '[package]\nname = "domain-market"\nversion = "0.1.0"\n',
    "a/src/lib.rs": """//! doc fn no()
pub mod price;
/// text {
pub struct Order { pub id: u64, qty: Vec<u32> }
pub enum Side { Buy, Sell(u8), Both { x: u8 } }
pub trait Book { fn top(&self) -> u64; }
impl Book for Order { fn top(&self) -> u64 { self.id.max(3) } }
impl<T: Clone> Wrapper<T> { pub(crate) fn get(&self, at: usize) -> T { inner::load::<T>(at, "a(b)").unwrap() } }
#[deprecated(since = "0.2")]
pub fn old(x: u8) -> u8 { if x > 1 && x < 4 { return helper(x); } match x { 0 => 1, 1 => 2, _ => Some(3).expect("x") } }
pub const fn cf() {}
pub const LIMIT: usize = 4;
#[cfg(test)]
mod tests { #[test] fn works() { super::old(1); let v = vec![helper(2)]; } }
""",
    "a/src/price.rs": "pub fn from_bid(b: &str) -> u8 { chrono::Utc::now(); 3 }\n",
    "docs/rfc 1+2.md": "# Prices\nAll of from_bid and domain_market::old.\n",
    ".cfdb/concepts/m.toml": 'name = "market"\ncrates = ["domain-market"]\ncanonical_crate = "domain-market"\n',
    ".cfdb/predicates/old.cypher": "MATCH (i:Item) WHERE i.is_deprecated = true AND i.kind = $kind RETURN i.qname AS qname, i.line AS line, 'old' AS reason",
}


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    top = tmp_path_factory.mktemp("work space+1")
    for path, text in FILES.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", str(top), "-c", "user.email=a@b", "-c", "user.name=a", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "a")
    git("commit", "-qm", "one\n\ntwo")
    (top / "a/src/price.rs").write_text(FILES["a/src/price.rs"] + "\n")
    git("commit", "-qam", "more")
    return str(top)


@pytest.fixture(scope="module")
def graph(spark, workspace):
    facts, warnings = producers.extract(spark, workspace)
    assert warnings == []
    return graph_of_facts(facts)


def test_rust_facts(graph):
    items = {r.qname: r for r in graph.nodes["Item"].collect()}
    assert {q.removeprefix("domain_market::"): r.kind for q, r in items.items()} == {"Order": "struct", "Side": "enum", "Book": "trait", "Book::top": "method", "Order::top": "method", "Wrapper::get": "method", "old": "fn", "cf": "fn", "LIMIT": "const", "tests::works": "fn", "price::from_bid": "fn"}
    old = items["domain_market::old"]
    assert (old.line, old.is_deprecated, old.deprecation_since, old.cyclomatic, old.unwrap_count, old.signature, old.visibility, old.bounded_context) == (10, True, "0.2", 5, 1, "fn old(x: u8) -> u8", "pub", "market")
    assert items["domain_market::Order::top"].impl_trait == "Book" and items["domain_market::Wrapper::get"].visibility == "pub(crate)"
    assert [q for q, r in items.items() if r.is_test] == ["domain_market::tests::works"]
    calls = {(r.caller_qname.split("::", 1)[1], r.callee_path, r.kind, r.arg_count) for r in graph.nodes["CallSite"].collect()}
    assert calls == {("Order::top", "max", "method", 1), ("Wrapper::get", "inner::load", "call", 2), ("Wrapper::get", "unwrap", "method", 0), ("old", "helper", "call", 1), ("old", "Some", "call", 1), ("old", "expect", "method", 1), ("tests::works", "super::old", "call", 1), ("tests::works", "helper", "call", 1), ("price::from_bid", "chrono::Utc::now", "call", 0)}
    assert {(r.name, r.payload_kind) for r in graph.nodes["Variant"].collect()} == {("Buy", "unit"), ("Sell", "tuple"), ("Both", "struct")}
    assert {(r.name, r.type_path) for r in graph.nodes["Field"].collect()} == {("id", "u64"), ("qty", "Vec<u32>")}
    (context,) = graph.nodes["Context"].collect()
    assert (context.name, context.source, context.owning_rfc.t) == ("market", "declared", 0)
    assert graph.ends["INVOKES_AT"] == ("Item", "CallSite") and graph.ends["IN_CRATE"] == (None, "Crate")
    assert set(graph.nodes) <= set(schema.NODES) and set(graph.edges) <= set(schema.EDGES)
    known = {label: {p.split(":")[0] for p in props.split()} for label, (_, props) in schema.NODES.items()}
    assert all(set(graph.properties("node", label)) <= known[label] for label in graph.nodes)


def test_other_languages(spark, tmp_path):
    php, ts = tmp_path / "p", tmp_path / "t"
    for top, files in ((php, {"composer.json": "{}", "src/A.php": "<?php\nnamespace App\\Core; # class No {}\nclass A { public function go($x) { return fn_call(); } }\ninterface B {}\nfunction free() {}\n", "vendor/x.php": "<?php class V {}"}), (ts, {"package.json": '{"name": "shop"}', "tsconfig.json": "{}", "src/a.ts": "export class A {\n  run(x: number): void { if (x) { go(x); } }\n}\ninterface B { z(): void }\nexport type T = string;\nexport const K = `class No {}`;\nfunction f() { const inner = 1; }\nenum E { X }\n", "node_modules/y.ts": "class N {}"})):
        for path, text in files.items():
            (top / path).parent.mkdir(parents=True, exist_ok=True)
            (top / path).write_text(text)
    of = lambda top: {(r.qname, r.kind) for r in graph_of_facts(producers.extract(spark, str(top))[0]).nodes["Item"].collect()}
    assert of(php) == {("App::Core::A", "trait"), ("App::Core::A::go", "fn"), ("App::Core::B", "trait"), ("App::Core::free", "fn")}
    assert of(ts) == {("shop::src::a::A", "struct"), ("shop::src::a::A::run", "fn"), ("shop::src::a::B", "trait"), ("shop::src::a::T", "type_alias"), ("shop::src::a::K", "const"), ("shop::src::a::f", "fn"), ("shop::src::a::E", "enum")}
    (php / "Cargo.toml").write_text("[workspace]")
    assert "several languages" in producers.extract(spark, str(php))[1][0]
    with pytest.raises(producers.NoProducer):
        producers.extract(spark, str(tmp_path))


def test_facts_and_order(spark, tmp_path):
    """Loaded through Spark, a graph is the one made from the facts at hand; ties keep their order."""
    nodes = [{"id": "a", "label": "N", "props": {"x": 1}}, {"id": "b", "label": "N", "props": {"x": "1", "n": None, "big": 1 << 70}}, {"id": "a", "label": "M", "props": {"y": [1], "z": True}}]
    edges = [{"src": "a", "dst": "b", "label": "R", "props": {"w": w}} for w in (9, 1, 5)] + [{"src": "b", "dst": "q", "label": "R"}]
    g = graph_of(spark, nodes, edges)
    lines = dump.canonical_dump(g).split("\n")
    assert [json.loads(x)["props"]["w"] for x in lines[2:]] == [9, 1, 5]
    save_json(g, str(tmp_path / "g.json"))
    doc = json.loads((tmp_path / "g.json").read_text())
    assert [e["props"]["w"] for e in doc["edges"]] == [9, 1, 5]
    doc["nodes"], doc["edges"] = nodes, edges
    (tmp_path / "h.json").write_text(json.dumps(doc))
    back = load_json(spark, f"file://{tmp_path}/h.json")
    assert dump.canonical_dump(back) == dump.canonical_dump(g) and back.warnings == g.warnings and back.ends == g.ends
    d = dump.diff(g, graph_of(spark, nodes, edges[:2]))
    assert [(json.loads(r.a)["props"], json.loads(r.b)["props"]) for r in d.changed.collect()] == [({"w": 5}, {"w": 1})]


def test_command_line(spark, workspace, tmp_path, capsys):
    db = ["--db", str(tmp_path / "db"), "--keyspace", "k"]

    def run(*argv):
        code = cli.main(list(argv), spark)
        out = capsys.readouterr()
        return code, json.loads(out.out) if code != 1 else out.err

    assert run("version")[1]["schema_version"] == "0.3.2" and len(run("schema-describe")[1]["nodes"]) == 13
    assert run("list-keyspaces", *db[:2]) == (0, [])
    assert run("query", *db, "MATCH (n) RETURN n")[0] == 1
    assert run("extract", *db, "--workspace", workspace)[1]["nodes"]["Item"] == 11
    assert run("list-keyspaces", *db[:2])[1] == ["k"] and run("snapshots", *db[:2])[1][0]["keyspace"] == "k"
    code, out = run("violations", *db, "--rule", "arch-ban-utc-now")
    assert code == 30 and [r["caller.qname"] for r in out["rows"]] == ["domain_market::price::from_bid"]
    assert run("violations", *db, "--rule", "arch-ban-utc-now", "--count-only", "--no-fail") == (0, {"violations": 1})
    assert [r["caller.qname"] for r in run("list-callers", *db, "--qname", "old$")[1]["rows"]] == ["domain_market::tests::works"]
    assert run("enrich-git-history", *db)[1]["ran"] is False
    assert run("enrich-git-history", *db, "--workspace", workspace)[1]["ran"]
    q = "MATCH (i:Item) WHERE i.name IN $names RETURN i.name AS name, i.git_commit_count AS n, i.git_last_author AS who"
    assert run("query", *db, "MATCH (i:Item {name: 'from_bid'}) RETURN i.git_commit_count AS n, i.git_last_author AS who")[1]["rows"] == [{"n": 2, "who": "a@b"}]
    assert run("query", *db, q, "--params", '{"names": ["x"]}')[0] == 1
    assert run("enrich-rfc-docs", *db, "--workspace", workspace)[1]["edges_written"] == 2
    assert run("query", *db, "MATCH (i:Item)-[:REFERENCED_BY]->(d:RfcDoc) RETURN i.name AS name, d.path AS path, d.title AS title ORDER BY name")[1]["rows"] == [{"name": n, "path": "docs/rfc 1+2.md", "title": "Prices"} for n in ("from_bid", "old")]
    assert run("enrich-concepts", *db, "--workspace", workspace)[1]["ran"] and run("enrich-bounded-context", *db, "--workspace", workspace)[1]["ran"]
    scope = run("scope", *db, "--context", "market")[1]
    assert [f["qname"] for f in scope["findings_by_class"]["unfinished_refactor"]] == ["domain_market::old"] and scope["loc_per_crate"] == {"domain-market": 11}
    assert run("check", *db, "--trigger", "T1")[0] == 0 and run("check", *db, "--trigger", "T3")[0] == 0
    assert run("check-predicate", *db, "--name", "old", "--workspace", workspace, "--param", "kind:literal:fn") == (30, {"rows": [{"qname": "domain_market::old", "line": 10, "reason": "old"}]})
    assert run("list-items-matching", *db, "--name-pattern", "^o", "--kinds", "Fn,ImplBlock")[1]["warnings"][0]["kind"] == "EmptyResult"
    assert run("export", *db, "--output", str(tmp_path / "db" / "j.json"))[0] == 0
    assert run("diff", *db, "--against", "j")[1]["added"] == []
    assert run("find-canonical", *db, "--concept", "c")[1]["ran"] is False
    assert run("drop", *db)[0] == 0 and run("list-keyspaces", *db[:2])[1] == ["j"]
